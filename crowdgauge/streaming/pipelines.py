"""Structured Streaming twins of ingest, heat, snapshots and alarms."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from .. import constants as K
from ..functions import values as V
from ..session import ensure_checkpoint_dir
from ..sources.store import CycleTable, KeyedTable


def landing_stream(spark: SparkSession, folder: str, files: str, schema: str,
                   max_files: int = 1000) -> DataFrame:
    """JSON lines of a growing folder; broken lines keep their text in ``_bad``."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", files)
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(folder)
    )


def fresh_only(stream: DataFrame, time: str, window_ms: int, now_ms: int | None = None) -> DataFrame:
    """Drop rows older than the window at the door. A watermark alone does not drop rows of a
    stateless stream, so the age test is explicit; the watermark bounds later state."""
    now = F.lit(now_ms) if now_ms is not None else F.unix_millis(F.current_timestamp())
    event = F.timestamp_millis(V.normalize_ts(time))
    return stream.withColumn("event_time", event).withWatermark(
        "event_time", f"{window_ms // K.HOUR_MS} hours").filter(V.normalize_ts(time) >= now - window_ms)


def known_notes_only(comments: DataFrame, notes: DataFrame) -> DataFrame:
    """Stream–static semi-join: comments whose note is in the table."""
    return comments.join(notes.select("note_id"), "note_id", "left_semi")


def first_seen(stream: DataFrame, key: str) -> DataFrame:
    """The first arrival of each key within the watermark."""
    return stream.dropDuplicatesWithinWatermark([key])


def upsert_batches(table: KeyedTable, order: str, preserve: list[str],
                   prepare: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges each micro-batch into the buckets of a keyed table that it touches."""

    def write(batch: DataFrame, batch_id: int) -> None:
        table.merge(prepare(batch) if prepare else batch, order, preserve, batch_id)

    return write


def snapshot_batches(table: CycleTable) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends score snapshots once per (ticker, cycle)."""
    return table.append_absent


def with_late_parents(comments: DataFrame, notes: DataFrame, comment_time: str, note_time: str, hold: str = "72 hours") -> DataFrame:
    """Comments whose note is seen at most ``hold`` before or after them, each once. Either side is held until the other comes or the
    watermark passes; both times are timestamps. On batch DataFrames the same join without the holding."""
    n = notes.select("note_id", F.col(note_time).alias("_note_time")).withWatermark("_note_time", hold)
    n = n.dropDuplicatesWithinWatermark(["note_id"]) if notes.isStreaming else n.groupBy("note_id").agg(F.min("_note_time").alias("_note_time"))
    c = comments.withWatermark(comment_time, hold)
    near = (F.col("_note_time") >= F.col(comment_time) - F.expr(f"INTERVAL {hold}")) & (F.col("_note_time") <= F.col(comment_time) + F.expr(f"INTERVAL {hold}"))
    n = n.withColumnRenamed("note_id", "_note_id")
    return c.join(n, (F.col("note_id") == F.col("_note_id")) & near).drop("_note_id", "_note_time")


def sliding_heat(mentions: DataFrame, time: str = "event_time", size: str = "24 hours",
                 slide: str = "1 hour") -> DataFrame:
    """Weighted mentions per entity in sliding windows. Input rows carry their weight ``w``; the
    same expression runs on a batch DataFrame."""
    return mentions.groupBy(F.window(time, size, slide).alias("w_"), "ticker").agg(
        F.count(F.lit(1)).alias("mentions"), F.sum("w").alias("heat")
    ).select(F.unix_millis("w_.start").alias("window_start_ms"), F.unix_millis("w_.end").alias("window_end_ms"),
             "ticker", "mentions", "heat")


def keyword_counts(notes: DataFrame) -> DataFrame:
    return notes.groupBy(F.coalesce("source_keyword", F.lit("?")).alias("keyword")).count()


def marker_alarms(lines: DataFrame, marker: str = K.CAPTCHA_MARKER, threshold: int = K.CAPTCHA_ALARM, since: int | None = None,
                  time: str | None = None, idle_hours: int = 24) -> DataFrame:
    """One alarm (run_id, keyword, captchas) when the marker count of a run and keyword reaches the threshold; ``captchas`` is the count
    at that moment. Lines are reduced to per-line counts before the shuffle. With ``since``, lines that start before
    that byte, as column ``start`` has it, are not counted. The state of a key is two numbers. With a timestamp column
    ``time``, a timer ends it ``idle_hours`` of event time after its last count; a timer in processing time would keep a run
    over what is available from ever ending."""
    if since is not None:
        lines = lines.filter(F.col("start") >= since)
    n = (F.length("line") - F.length(F.replace("line", F.lit(marker), F.lit("")))) / len(marker)
    counted = lines.select("run_id", "keyword", *([time] if time else []), n.cast("bigint").alias("n")).filter("n > 0")
    if time:
        counted = counted.withWatermark(time, f"{idle_hours} hours")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        import pandas

        if state.hasTimedOut:
            state.remove()
            return
        total, raised = state.get if state.exists else (0, False)
        for b in batches:
            total += int(b["n"].sum())
        due = total >= threshold and not raised
        state.update((total, bool(raised or due)))
        if time:
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + idle_hours * K.HOUR_MS + 1)
        if due:
            yield pandas.DataFrame({"run_id": [key[0]], "keyword": [key[1]], "captchas": [total]})

    return counted.groupBy("run_id", "keyword").applyInPandasWithState(
        step, "run_id bigint, keyword string, captchas bigint", "total bigint, raised boolean",
        "append", GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drive a stream through everything available and read what it wrote.

    Results and progress are files in the shared folder, so nothing gathers on the driver and a restarted run takes
    up where it stopped. In complete and update mode each trigger writes a version of its own; the last one is
    read. A stream that had nothing to read gives an empty table."""
    spark = stream.sparkSession
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True)
    schema = stream.schema
    if mode == "append":
        writer.format("parquet").option("path", f"{root}/rows").start().awaitTermination()
        return spark.read.schema(schema).parquet(f"{root}/rows") if _holds(spark, f"{root}/rows") else spark.createDataFrame([], schema)
    written: list[int] = []

    def version(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/version={n}")
        written.append(n)

    writer.foreachBatch(version).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{root}/rows/version={written[-1]}") if written else spark.createDataFrame([], schema)


def _holds(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
