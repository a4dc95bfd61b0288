"""Landing files: JSON lines of posts and comments, run logs; quarantine and ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from .. import schemas as S
from ..functions import text as T
from ..functions import values as V
from ..functions.python_text import nfkc
from ..operators.tables import upsert

NOTE_FILES = "search_contents_*.jsonl"
COMMENT_FILES = "search_comments_*.jsonl"


def read_jsonl(spark: SparkSession, folder: str, files: str, schema: str) -> DataFrame:
    """JSON lines with an explicit schema; a broken line keeps its text in ``_bad``. Blank lines
    are skipped. ``line_no`` orders lines by file name, then position."""
    lines = spark.read.text(folder, pathGlobFilter=files, recursiveFileLookup=True)
    source = lines.select(
        F.trim("value").alias("value"), F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_seq"))
    return parse_lines(source.withColumn("line_no", F.struct("_file", "_block", "_seq")), schema)


def parse_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Parse JSON text lines (value, line_no); blank lines are skipped."""
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.filter(F.trim("value") != "").select("line_no", parsed.alias("r")).select("r.*", "line_no")


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    return read_jsonl(spark, folder, NOTE_FILES, S.LANDING_NOTE)


def read_comments(spark: SparkSession, folder: str) -> DataFrame:
    return read_jsonl(spark, folder, COMMENT_FILES, S.LANDING_COMMENT)


def read_logs(spark: SparkSession, path: str, tail_lines: int | None = None) -> DataFrame:
    """(file, lineno, line) of text logs; one file is one run's log. ``tail_lines`` keeps the end of each file.

    Files are read in splits. A line's number is its place in its split plus the lines of the splits before it, so only
    one row per split is ordered, never the lines of a file."""
    lines = spark.read.text(path, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))
    splits = lines.groupBy("file", "block").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    per_file = Window.partitionBy("file").orderBy("block")
    splits = splits.withColumn("before", F.sum("n").over(per_file) - F.col("n")).withColumn(
        "total", F.sum("n").over(Window.partitionBy("file"))).drop("n")
    placed = lines.join(splits, ["file", "block"]).withColumn("lineno", F.col("before") + F.col("seq") - F.col("first"))
    if tail_lines is not None:
        placed = placed.filter(F.col("lineno") >= F.col("total") - tail_lines)
    return placed.select("file", "lineno", "line")


def line_counts(spark: SparkSession, folder: str, prefixes=("search_contents", "search_comments")) -> DataFrame:
    """Lines per file prefix."""
    lines = spark.read.text(folder, recursiveFileLookup=True).select(F.col("_metadata.file_name").alias("f"))
    prefix = F.coalesce(*[F.when(F.startswith("f", F.lit(p + "_")), F.lit(p)) for p in prefixes])
    return lines.withColumn("prefix", prefix).filter(F.col("prefix").isNotNull()).groupBy("prefix").agg(
        F.count(F.lit(1)).alias("lines"))


def is_malformed(ids: list[str], time: str) -> Column:
    bad = F.col("_bad").isNotNull() | V.normalize_ts(time).isNull()
    for c in ids:
        bad = bad | F.col(c).isNull() | (F.col(c) == "")
    return bad


def quarantine(landed: DataFrame, ids: list[str], time: str) -> tuple[DataFrame, DataFrame]:
    """(usable, malformed) rows."""
    bad = is_malformed(ids, time)
    return landed.filter(~bad), landed.filter(bad)


def note_rows(landed: DataFrame, run_id: int, window_ms: int, now_ms: int) -> DataFrame:
    """Usable notes of the window in table form; of several lines for a note the last wins. Texts are stored
    in exact compatibility form, so that matching, hashes and excerpts all see the same characters."""
    ts = V.normalize_ts("time")
    usable, _ = quarantine(landed, ["note_id"], "time")
    rows = usable.filter(ts >= now_ms - window_ms).select(
        "note_id", nfkc("title").alias("title"), nfkc("desc").alias("note_desc"),
        F.col("type").alias("note_type"), ts.alias("publish_time_ms"),
        *[V.parse_count(c).alias(c) for c in ("liked_count", "collected_count", "comment_count", "share_count")],
        "note_url", "tag_list", "source_keyword", "nickname",
        F.lit(run_id).cast("bigint").alias("first_seen_run_id"), F.lit(run_id).cast("bigint").alias("last_seen_run_id"),
        F.lit(now_ms).cast("bigint").alias("fetched_at_ms"), "line_no")
    return _fold(rows, "note_id", ["publish_time_ms", "first_seen_run_id"])


def _fold(rows: DataFrame, key: str, preserve: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in (key, "line_no", *preserve)]
    return rows.groupBy(key).agg(
        F.max_by(F.struct(*rest), "line_no").alias("l"), F.min_by(F.struct(*preserve), "line_no").alias("f")
    ).select(key, *[F.col(f"f.{c}") if c in preserve else F.col(f"l.{c}")
                    for c in rows.columns if c not in (key, "line_no")])


def ingest_notes(existing: DataFrame, landed: DataFrame, run_id: int, window_ms: int, now_ms: int) -> DataFrame:
    """The note table after a run. Publish time and first run of a known note are kept."""
    rows = note_rows(landed, run_id, window_ms, now_ms)
    return upsert(existing, rows.select(*[c for c in existing.columns if c in rows.columns]), ["note_id"],
                  "fetched_at_ms", preserve=["publish_time_ms", "first_seen_run_id"])


def comment_rows(landed: DataFrame, notes: DataFrame, run_id: int, window_ms: int, now_ms: int) -> DataFrame:
    """Usable comments of the window whose note is known."""
    ts = V.normalize_ts("create_time")
    usable, _ = quarantine(landed, ["comment_id", "note_id"], "create_time")
    norm = T.norm_for_hash("content")
    known = usable.filter(ts >= now_ms - window_ms).join(notes.select("note_id"), "note_id", "left_semi")
    rows = known.withColumn("content", nfkc("content")).select(
        "comment_id", "note_id", "parent_comment_id", "content",
        ts.alias("create_time_ms"), V.parse_count("like_count").alias("like_count"),
        V.parse_count("sub_comment_count").alias("sub_comment_count"), "nickname",
        F.when(F.length(norm) >= K.MIN_COMMENT_DEDUP_LEN, norm).alias("content_norm_hash"),
        F.lit(run_id).cast("bigint").alias("first_seen_run_id"), F.lit(now_ms).cast("bigint").alias("fetched_at_ms"),
        "line_no")
    return _fold(rows, "comment_id", ["note_id", "create_time_ms", "first_seen_run_id"])


def ingest_comments(existing: DataFrame, landed: DataFrame, notes: DataFrame, run_id: int, window_ms: int,
                    now_ms: int) -> DataFrame:
    rows = comment_rows(landed, notes, run_id, window_ms, now_ms)
    return upsert(existing, rows.select(*[c for c in existing.columns if c in rows.columns]), ["comment_id"],
                  "fetched_at_ms", preserve=["note_id", "create_time_ms", "first_seen_run_id"])


def accounting(landed_notes: DataFrame, landed_comments: DataFrame, notes: DataFrame, window_ms: int,
               now_ms: int) -> DataFrame:
    """One row: notes_fetched, notes_fresh, comments_seen, comments_fresh, malformed."""
    n_bad, c_bad = is_malformed(["note_id"], "time"), is_malformed(["comment_id", "note_id"], "create_time")
    n = landed_notes.select(F.lit("note").alias("k"), n_bad.alias("bad"),
                            (V.normalize_ts("time") >= now_ms - window_ms).alias("fresh"))
    known = notes.select("note_id", F.lit(True).alias("known"))
    c = landed_comments.join(known, "note_id", "left").select(
        F.lit("comment").alias("k"), c_bad.alias("bad"),
        ((V.normalize_ts("create_time") >= now_ms - window_ms) & F.coalesce("known", F.lit(False))).alias("fresh"))
    note, good = F.col("k") == "note", ~F.col("bad")
    return n.unionByName(c).agg(
        F.count_if(note & good).alias("notes_fetched"), F.count_if(note & good & F.col("fresh")).alias("notes_fresh"),
        F.count_if(~note & good).alias("comments_seen"), F.count_if(~note & good & F.col("fresh")).alias("comments_fresh"),
        F.count_if("bad").alias("malformed"))
