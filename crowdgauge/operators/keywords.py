"""Keyword yield and attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def yield_stats(notes: DataFrame, mentions: DataFrame, run_id: int | None = None,
                since_ms: int | None = None) -> DataFrame:
    """Per search keyword: notes, notes naming an entity, distinct entities, hit rate.

    Notes and mentions are first reduced to one row per note, so the distinct counts are plain
    sums over notes and a set of entities per keyword.
    """
    rows = notes.filter(F.col("source_keyword").isNotNull())
    if run_id is not None:
        rows = rows.filter(F.col("last_seen_run_id") == run_id)
    elif since_ms is not None:
        rows = rows.filter(F.col("fetched_at_ms") >= since_ms)
    named = mentions.filter("source_type = 'note'").groupBy(F.col("source_id").alias("note_id")).agg(
        F.collect_set("ticker").alias("tickers"))
    per_note = rows.select("note_id", "source_keyword").distinct().join(named, "note_id", "left")
    counts = per_note.groupBy(F.col("source_keyword").alias("keyword")).agg(
        F.count(F.lit(1)).alias("notes"), F.count("tickers").alias("with_stock"))
    entities = per_note.select(F.col("source_keyword").alias("keyword"), F.explode("tickers").alias("ticker")).groupBy(
        "keyword").agg(F.array_sort(F.collect_set("ticker")).alias("tickers"))
    return counts.join(entities, "keyword", "left").select(
        "keyword", "notes", "with_stock", F.round(F.col("with_stock") / F.col("notes"), 2).alias("hit_rate"),
        F.coalesce(F.size("tickers"), F.lit(0)).alias("n_tickers"),
        F.coalesce("tickers", F.array().cast("array<string>")).alias("tickers"),
    ).orderBy(F.desc("with_stock"), F.desc("notes"), "keyword")


def attribution(landed_notes: DataFrame, landed_comments: DataFrame, order: str = "line_no",
                by: tuple[str, ...] = ()) -> DataFrame:
    """Per keyword: landed note lines and comment lines. A comment belongs to the keyword of its
    note's last line; comments of unknown notes are not counted. With ``by`` (say the run), both
    tables have these columns and are counted apart for each of their values."""
    kw = F.coalesce(F.when(F.col("source_keyword") != "", F.col("source_keyword")), F.lit("?"))
    n = landed_notes.withColumn("keyword", kw)
    owner = n.filter(F.col("note_id").isNotNull() & (F.col("note_id") != "")).groupBy(*by, "note_id").agg(
        F.max_by("keyword", order).alias("keyword"))
    per_note = landed_comments.groupBy(*by, "note_id").agg(F.count(F.lit(1)).alias("c"))
    comments = per_note.join(owner, [*by, "note_id"]).groupBy(*by, "keyword").agg(F.sum("c").alias("comments"))
    notes = n.groupBy(*by, "keyword").agg(F.count(F.lit(1)).alias("notes"))
    return notes.join(comments, [*by, "keyword"], "full_outer").fillna(0, ["notes", "comments"])
