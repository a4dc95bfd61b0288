"""Operators over files: the test tables written as landing files and logs in the shared folder, and read back."""

import uuid

from pyspark.sql import functions as F

from crowdgauge import schemas as S
from crowdgauge.session import ensure_checkpoint_dir
from crowdgauge.sources import growing as GR
from crowdgauge.sources import landing as LD
from crowdgauge.sources.store import CycleTable, KeyedTable
from crowdgauge.streaming import pipelines as SP

from .base import Registry

Q = Registry()


def folder(t, name):
    return f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/files/{name}-{uuid.uuid4().hex}"


def written(df, path, prefix):
    """JSON lines in files named as a crawl names them."""
    spark, raw = df.sparkSession, f"{path}/raw-{uuid.uuid4().hex}"
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(raw)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(raw)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for k, f in enumerate(sorted(x.getPath().getName() for x in fs.listStatus(at))):
        if f.startswith("part-"):
            fs.rename(jvm.org.apache.hadoop.fs.Path(at, f), jvm.org.apache.hadoop.fs.Path(path, f"{prefix}_{uuid.uuid4().hex}_{k}.jsonl"))


def landing_notes(t, suffix=""):
    i = F.col("doc_id")
    return t.raw("documents").select(i.cast("string").alias("note_id"), F.concat(F.substring_index("text", "\n", 1), F.lit(suffix)).alias("title"),
                                     F.col("text").alias("desc"), (F.lit(t.now) - i * 1000).cast("string").alias("time"))


def landing_comments(t):
    c = F.col("conv_id")
    return t.raw("conversations").select(F.concat_ws("-", c, "turn").alias("comment_id"), c.cast("string").alias("note_id"), F.col("text").alias("content"),
                                         F.lit(t.now).cast("string").alias("create_time"))


RUN = "conv_id // 40"  # conversations of one log, so that the number of logs follows the table


def logs_of(t):
    """The conversations as one log for each run; returns the folder."""
    path = folder(t, "logs")
    c = t.raw("conversations").select(F.floor(F.col("conv_id") / 40).alias("run"), "conv_id", "turn", F.translate("text", "\n\r", "  ").alias("value"))
    c.repartition("run").sortWithinPartitions("run", "conv_id", "turn").select("run", "value").write.partitionBy("run").text(path)
    return path


def run_of(file):
    return F.regexp_extract(file, "run=([0-9]+)", 1).cast("long").alias("run")


LOG_SQL = f"SELECT {RUN} AS run, replace(replace(text, chr(10), ' '), chr(13), ' ') AS line, conv_id, turn FROM conversations"


@Q.add("a12_log_lines", "", f"SELECT CAST(run AS BIGINT) AS run, row_number() OVER (PARTITION BY run ORDER BY conv_id, turn) - 1 AS lineno, line FROM ({LOG_SQL})")
def _(t):
    return LD.read_logs(t.spark, logs_of(t)).select(run_of("file"), "lineno", "line")


@Q.add("a12_log_slice", "", f"""SELECT CAST(run AS BIGINT) AS run, CAST(start AS BIGINT) AS start, line FROM (
  SELECT run, line, sum(strlen(line) + 1) OVER (PARTITION BY run ORDER BY conv_id, turn) - strlen(line) - 1 AS start FROM ({LOG_SQL})) WHERE start >= 1000""")
def _(t):
    # From the byte before, so that a line which starts at 1000 is told from the rest of one that doesn't.
    rows = GR.line_slice(t.spark, logs_of(t), "*.txt", start=999)
    return rows.filter("start >= 1000").select(run_of("file"), "start", "line")


@Q.add("g21_line_counts", "", """SELECT 'search_contents' AS prefix, count(*) AS lines FROM documents UNION ALL SELECT 'search_comments', count(*) FROM conversations""")
def _(t):
    path = folder(t, "landing")
    written(landing_notes(t), path, "search_contents")
    written(landing_comments(t), path, "search_comments")
    return LD.line_counts(t.spark, path)


def grown(t, df, path, prefix, late=None):
    """JSON lines dealt to files by id; rows for which ``late`` holds come last in their file. Without them the files are the
    beginnings of what they are with them."""
    spark, raw = t.spark, f"{path}/_raw-{uuid.uuid4().hex}"
    line = F.to_json(F.struct(*df.columns)).alias("value")
    rows = df.select("note_id", (late if late is not None else F.lit(False)).alias("late"), line)
    rows.repartition(8, "note_id").sortWithinPartitions("late", "note_id").select("value").write.text(raw)
    jvm = spark._jvm
    at, to = jvm.org.apache.hadoop.fs.Path(raw), jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in (x.getPath().getName() for x in fs.listStatus(at)):
        if f.startswith("part-"):
            file = jvm.org.apache.hadoop.fs.Path(to, f"{prefix}_{f[5:10]}.jsonl")
            fs.delete(file, False)
            fs.rename(jvm.org.apache.hadoop.fs.Path(at, f), file)


@Q.add("st01_landing_stream", "", """SELECT CAST(doc_id AS VARCHAR) AS note_id, md5(text) AS digest FROM documents""")
def _(t):
    path, notes, late = folder(t, "landing"), landing_notes(t), F.pmod(F.xxhash64("note_id"), F.lit(2)) == 1
    written(landing_comments(t), path, "search_comments")
    for rows in (notes.filter(~late), notes):  # the files grow between two runs of the stream
        grown(t, rows, path, "search_contents", late)
        stream = GR.growing_json(t.spark, path, LD.NOTE_FILES, S.LANDING_NOTE)
        stream.filter("_bad is null").select("note_id", F.md5("desc").alias("digest")).writeStream.format("parquet").option("path", f"{path}-rows").option(
            "checkpointLocation", f"{path}-progress").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("note_id string, digest string").parquet(f"{path}-rows")


@Q.add("st03_stream_upsert", "", f"""SELECT CAST(doc_id AS VARCHAR) AS note_id, split_part(text, chr(10), 1) || ' again' AS title, CAST(2 AS BIGINT) AS seen,
  CAST({1704153600000 + 28 * 86400000} - doc_id * 1000 AS BIGINT) AS publish_time_ms FROM documents""")
def _(t):
    path = folder(t, "landing")
    table = KeyedTable(t.spark, f"{path}-table", "note_id string, title string, seen bigint, publish_time_ms bigint", ["note_id"])
    for seen, suffix in ((1, ""), (2, " again")):  # a second crawl meets every note again, its time moved
        written(landing_notes(t, suffix).withColumn("time", (F.col("time").cast("long") + (seen - 1) * 5).cast("string")), path, "search_contents")

        def prepare(batch, seen=seen):
            good, _ = LD.quarantine(batch, ["note_id"], "time")
            return good.select("note_id", "title", F.lit(seen).cast("long").alias("seen"), LD.V.normalize_ts("time").alias("publish_time_ms"))

        stream = SP.landing_stream(t.spark, path, LD.NOTE_FILES, S.LANDING_NOTE)
        stream.writeStream.foreachBatch(SP.upsert_batches(table, "seen", ["publish_time_ms"], prepare)).option(
            "checkpointLocation", f"{path}-progress").trigger(availableNow=True).start().awaitTermination()
    return table.read()


@Q.add("st06_stream_snapshots", "snaps", "SELECT ticker, snapped_at_ms, score, mentions FROM snaps")
def _(t):
    path = folder(t, "snapshots")
    names = [x.split()[0] for x in S.SNAPSHOTS.split(", ")]
    have = t.snapshots.columns
    rows = t.snapshots.select(*[F.col(c) if c in have else F.lit(0).alias(c) for c in names])
    rows = t.spark.createDataFrame([], S.SNAPSHOTS).unionByName(rows.select(*[F.col(f.name).cast(f.dataType) for f in t.spark.createDataFrame([], S.SNAPSHOTS).schema]))
    table = CycleTable(t.spark, f"{path}-table", S.SNAPSHOTS, ["ticker", "snapped_at_ms"], "snapped_at_ms")
    for _ in range(2):  # every cycle arrives twice
        rows.write.mode("append").parquet(path)
        stream = t.spark.readStream.schema(S.SNAPSHOTS).parquet(path)
        stream.writeStream.foreachBatch(SP.snapshot_batches(table)).option("checkpointLocation", f"{path}-progress").trigger(
            availableNow=True).start().awaitTermination()
    return table.read().select("ticker", "snapped_at_ms", "score", "mentions")


@Q.add("st03_first_seen", "", "SELECT CAST(doc_id AS VARCHAR) AS note_id FROM documents")
def _(t):
    path = folder(t, "landing")
    for suffix in ("", " again"):
        written(landing_notes(t, suffix), path, "search_contents")
    stream = SP.fresh_only(SP.landing_stream(t.spark, path, LD.NOTE_FILES, S.LANDING_NOTE), "time", 10**15, t.now)
    return SP.run_available(SP.first_seen(stream, "note_id").select("note_id"), "st03_first")
