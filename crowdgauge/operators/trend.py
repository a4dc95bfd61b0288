"""Score snapshots: trend between the last two cycles and zero-filled history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .tables import insert_absent


def snapshot_rows(stats: DataFrame, run_id: int | None, now_ms: int) -> DataFrame:
    """One row per entity; all rows of a cycle share its time."""
    return stats.select(
        "ticker", F.lit(run_id).cast("bigint").alias("run_id"),
        F.lit(now_ms).cast("bigint").alias("snapped_at_ms"), "score", "mentions", "note_count",
        "comment_count")


def new_snapshots(existing: DataFrame, rows: DataFrame) -> DataFrame:
    return insert_absent(existing, rows, ["ticker", "snapped_at_ms"])


def last_cycles(snapshots: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` distinct cycle times."""
    return snapshots.select("snapped_at_ms").distinct().orderBy(F.desc("snapped_at_ms")).limit(n)


def compute_trends(snapshots: DataFrame) -> DataFrame:
    """Latest cycle against the one before: (ticker, dir, delta_pct, prev_score). Empty until two
    cycles exist; entities only in the earlier cycle are left out."""
    cycles = last_cycles(snapshots, 2)
    bounds = cycles.agg(F.max("snapped_at_ms").alias("latest"), F.min("snapped_at_ms").alias("prev"),
                        F.count(F.lit(1)).alias("n")).filter("n = 2")
    two = snapshots.join(F.broadcast(cycles), "snapped_at_ms")  # at most two rows
    two = two.withColumns({"latest": bounds.select("latest").scalar(),
                           "prev": bounds.select("prev").scalar()})
    now = F.col("snapped_at_ms") == F.col("latest")
    t = two.filter(F.col("latest").isNotNull()).groupBy("ticker").agg(
        F.max(F.when(now, F.col("score"))).alias("score"),
        F.max(F.when(~now, F.col("score"))).alias("p"),
    ).filter(F.col("score").isNotNull())
    delta = F.col("score") - F.col("p")
    pct = F.when(F.col("p") > 0, delta / F.col("p") * 100)
    direction = (
        F.when(F.col("p").isNull(), "new")
        .when((pct >= K.TREND_PCT) & (delta >= K.TREND_MIN_ABS_DELTA), "up")
        .when((pct <= -K.TREND_PCT) & (-delta >= K.TREND_MIN_ABS_DELTA), "down")
        .otherwise("flat")
    )
    return t.select(
        "ticker", direction.alias("dir"),
        F.when(F.col("p") >= K.TREND_PCT_BASE_MIN, F.bround(pct, 0).cast("bigint")).alias("delta_pct"),
        F.coalesce("p", F.lit(0.0)).alias("prev_score"),
    )


def history_rows(snapshots: DataFrame, tickers: DataFrame, cycles: int = K.HISTORY_CYCLES) -> DataFrame:
    """(ticker, snapped_at_ms, score) for every asked entity and recent cycle, zero-filled.

    The spine is built by giving each entity the array of at most ``cycles`` times.
    """
    times = last_cycles(snapshots, cycles).agg(
        F.sort_array(F.collect_list("snapped_at_ms")).alias("t")).scalar()
    spine = tickers.select("ticker").distinct().withColumn("_t", times).select(
        "ticker", F.explode("_t").alias("snapped_at_ms"))
    return spine.join(snapshots.select("ticker", "snapped_at_ms", "score"),
                      ["ticker", "snapped_at_ms"], "left").fillna({"score": 0.0})


def score_history(snapshots: DataFrame, tickers: DataFrame, cycles: int = K.HISTORY_CYCLES) -> DataFrame:
    """(ticker, history): array of (ts, score), oldest first."""
    point = F.struct(F.col("snapped_at_ms").alias("ts"), "score")
    return history_rows(snapshots, tickers, cycles).groupBy("ticker").agg(
        F.array_sort(F.collect_list(point)).alias("history"))
