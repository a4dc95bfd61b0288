"""Heat: how much each entity is being talked about in a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import values as V
from .facts import with_facts

SOURCE = ["source_type", "source_id"]


def source_tickers(mentions: DataFrame, cutoff_ms: int) -> DataFrame:
    """(source_type, source_id, tickers): the set of entities each source names."""
    return mentions.filter(F.col("content_time_ms") >= cutoff_ms).groupBy(*SOURCE).agg(
        F.array_sort(F.collect_set("ticker")).alias("tickers"))


def source_fanout(mentions: DataFrame, cutoff_ms: int) -> DataFrame:
    """(source_type, source_id, fanout): entities per source whatever their class."""
    return mentions.filter(F.col("content_time_ms") >= cutoff_ms).groupBy(*SOURCE).agg(
        F.count_distinct("ticker").alias("fanout"))


def class_fanout(mentions: DataFrame, cutoff_ms: int, non_stocks: DataFrame) -> DataFrame:
    """Window mentions with ``fanout``: entities of the same kind the source names. Stocks divide
    among stocks, everything else among everything else."""
    flagged = with_kind(mentions.filter(F.col("content_time_ms") >= cutoff_ms), non_stocks)
    peers = Window.partitionBy(*SOURCE, "is_index")
    return flagged.withColumn("fanout", F.count(F.lit(1)).over(peers))


def with_kind(mentions: DataFrame, non_stocks: DataFrame) -> DataFrame:
    flags = non_stocks.select("ticker", F.lit(True).alias("is_index")).distinct()
    return mentions.join(flags, "ticker", "left").withColumn(
        "is_index", F.coalesce("is_index", F.lit(False)))


def note_mentions(mentions: DataFrame, notes: DataFrame) -> DataFrame:
    """Mentions joined with the note that makes them."""
    n = notes.select(F.col("note_id").alias("source_id"), "title", "note_desc", "publish_time_ms",
                     "note_url", F.col("liked_count").alias("likes"), "dup_group_id")
    return mentions.filter("source_type = 'note'").join(n, "source_id")


def comment_mentions(mentions: DataFrame, comments: DataFrame) -> DataFrame:
    """Mentions joined with the comment that makes them."""
    c = comments.select(F.col("comment_id").alias("source_id"), "content", "create_time_ms",
                        "parent_comment_id", F.col("like_count").alias("likes"), "dup_group_id")
    return mentions.filter("source_type = 'comment'").join(c, "source_id")


def scored_sources(mentions: DataFrame, notes: DataFrame, comments: DataFrame,
                   cutoffs: dict[str, int], non_stocks: DataFrame,
                   source_cutoff_ms: int | None = None) -> DataFrame:
    """One row per mention and window with everything the score needs. Fan-out is counted in the
    source's own array, so no window function is needed. Texts are not read: mentions bring their facts, and of
    notes and comments only likes and cluster are looked up.

    Where mention times equal source times, as in tables this library writes, pass the cutoff as
    ``source_cutoff_ms`` too: old sources are then skipped at the scan.
    """
    told = with_facts(mentions.filter(F.col("content_time_ms") >= min(cutoffs.values())), notes, comments)
    window = with_kind(told, non_stocks)
    if source_cutoff_ms is not None:
        notes = notes.filter(F.col("publish_time_ms") >= source_cutoff_ms)
        comments = comments.filter(F.col("create_time_ms") >= source_cutoff_ms)
    canonical = F.col("dup_group_id").isNull().alias("canonical")
    sources = notes.select(F.lit("note").alias("source_type"), F.col("note_id").alias("source_id"), F.col("liked_count").alias("likes"), canonical).unionByName(
        comments.select(F.lit("comment").alias("source_type"), F.col("comment_id").alias("source_id"), F.col("like_count").alias("likes"), canonical))
    needed = F.struct("ticker", "content_time_ms", "is_index", *[F.col(f"facts.{c}").alias(c) for c in ("aside", "in_prose", "readable", "quote")])
    named = window.groupBy(*SOURCE).agg(F.collect_list(needed).alias("named"))

    def inside(name: str, cut: int) -> Column:
        return F.transform(F.filter("named", lambda m: m["content_time_ms"] >= cut), lambda m: F.struct(F.lit(name).alias("window"), m.alias("m")))

    per_window = F.concat(*[inside(*w) for w in cutoffs.items()])
    peers = F.transform(per_window, lambda x: F.struct(
        x["window"].alias("window"), x["m"].alias("m"),
        F.size(F.filter(per_window, lambda y: (y["window"] == x["window"]) & (y["m"]["is_index"] == x["m"]["is_index"]))).alias("fanout")))
    # The fan-out is counted before the join, which then is one to one and moves what the explode needs.
    counted = named.select(*SOURCE, peers.alias("named"))
    return counted.join(sources, SOURCE).select(*SOURCE, "likes", "canonical", F.inline("named")).select(
        *SOURCE, "window", "m.ticker", "m.content_time_ms", "likes", "fanout", "canonical", "m.readable", "m.quote", "m.aside", "m.in_prose")


def _stats(sources: DataFrame, groups: list[str]) -> DataFrame:
    k = F.col("fanout")
    is_note, canonical = F.col("source_type") == "note", F.col("canonical")
    rows = sources.withColumns({
        "w": (1.0 / k) * F.when(F.col("aside"), K.ASIDE_WEIGHT).otherwise(1.0),
        "focused": (k <= K.FOCUS_MAX_FANOUT) & F.col("in_prose"),
    })
    note, comment = canonical & is_note, canonical & ~is_note
    heat = F.col("w") * V.like_weight(F.coalesce("likes", F.lit(0)))
    order = F.struct(
        (~F.col("readable")).cast("int"), F.col("aside").cast("int"),
        (~F.col("focused")).cast("int"), -F.coalesce("likes", F.lit(0)),
        F.when(is_note, 0).otherwise(1), F.col("source_id"),
    )

    def total(when: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, value)), F.lit(0.0))

    return rows.groupBy(*groups).agg(
        F.count_if(note).alias("note_count"),
        F.count_if(comment).alias("comment_count"),
        F.count_if(is_note).alias("note_count_raw"),
        F.count_if(~is_note).alias("comment_count_raw"),
        F.count_if(canonical & F.col("focused")).alias("focused_mentions"),
        F.count_if(canonical).alias("mentions"),
        F.round(
            K.W_NOTE * total(note, F.col("w")) + K.W_COMMENT * total(comment, F.col("w"))
            + K.W_NOTE_LIKES * total(note, heat) + K.W_COMMENT_LIKES * total(comment, heat), 2
        ).alias("score"),
        F.max("content_time_ms").alias("latest_item_ms"),
        F.min_by(F.when(canonical, F.col("quote")), F.when(canonical, order)).alias("top_quote"),
    )


def compute_stats(mentions: DataFrame, notes: DataFrame, comments: DataFrame, window_ms: int,
                  now_ms: int, non_stocks: DataFrame, prune_sources: bool = False) -> DataFrame:
    """Per-entity statistics of one window: raw and canonical counts, focused mentions, score,
    latest item and top quote."""
    cut = now_ms - window_ms
    sources = scored_sources(mentions, notes, comments, {"": cut}, non_stocks, cut if prune_sources else None)
    return _stats(sources, ["ticker"])


def compute_windows(mentions: DataFrame, notes: DataFrame, comments: DataFrame, windows_ms: dict[str, int],
                    now_ms: int, non_stocks: DataFrame, prune_sources: bool = False) -> DataFrame:
    """Statistics of several windows from one scan: adds a ``window`` column."""
    cutoffs = {name: now_ms - w for name, w in windows_ms.items()}
    first = min(cutoffs.values()) if prune_sources else None
    return _stats(scored_sources(mentions, notes, comments, cutoffs, non_stocks, first), ["window", "ticker"])
