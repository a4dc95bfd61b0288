"""Was the crowd right? Calls from analyses, scored against later closes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import values as V
from .asof import asof_join, day_number


def daily_calls(analyses: DataFrame, since_ms: int) -> DataFrame:
    """The last clearly leaning ok analysis per (ticker, UTC day)."""
    net = V.lean("sentiment_counts")
    rows = analyses.filter((F.col("status") == "ok") & (F.col("generated_at_ms") >= since_ms)).select(
        "ticker", "generated_at_ms", V.utc_day("generated_at_ms").alias("date"), net.alias("net")
    ).filter(F.abs("net") >= K.LEAN_MIN)
    return rows.groupBy("ticker", "date").agg(
        F.max_by("net", F.struct("generated_at_ms", "net")).alias("net")
    ).withColumn("dir", F.when(F.col("net") > 0, "up").otherwise("down"))


def baseline(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls with the last close on or before their day: base_close, base_day."""
    c = calls.withColumn("day", day_number("date"))
    p = prices.select("ticker", day_number("date").alias("day"), "close")
    return asof_join(c, p, ["ticker"], "day", "day", ["close"], prefix="base_")


def score_calls(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls with the move to the next close and to the first close a week on, and whether the
    direction was right. A call without a later close stays open; no move counts as wrong."""
    p = prices.select("ticker", day_number("date").alias("day"), "close")
    based = baseline(calls, prices)
    usable = based.withColumn("base_day", F.when(F.col("base_close") != 0, F.col("base_day")))
    one = asof_join(usable.withColumn("probe", F.col("base_day") + 1), p, ["ticker"], "probe", "day",
                    ["close"], forward=True, prefix="next_").drop("probe", "next_day")
    week = asof_join(one.withColumn("probe", F.col("base_day") + 7), p, ["ticker"], "probe", "day",
                     ["close"], forward=True, prefix="week_").drop("probe", "week_day")

    def move(close: str) -> Column:
        ok = F.col("base_day").isNotNull()
        return F.when(ok, F.round((F.col(close) - F.col("base_close")) / F.col("base_close") * 100, 2))

    def correct(m: str) -> Column:
        right = (F.col(m) > 0) == (F.col("dir") == "up")
        return F.when(F.col(m) == 0, False).otherwise(F.when(F.col(m).isNotNull(), right))

    moved = week.withColumns({"move_1d_pct": move("next_close"), "move_7d_pct": move("week_close")})
    return moved.select(
        "ticker", "date", "dir", "net", "move_1d_pct", correct("move_1d_pct").alias("correct_1d"),
        "move_7d_pct", correct("move_7d_pct").alias("correct_7d"))


def _rates() -> list[Column]:
    out = [F.count(F.lit(1)).alias("calls")]
    for h in ("1d", "7d"):
        done = F.count(f"correct_{h}")
        right = F.count_if(F.col(f"correct_{h}"))
        out += [done.alias(f"evaluated_{h}"), right.alias(f"correct_{h}"),
                F.when(done > 0, F.round(right / done * 100, 1)).alias(f"hit_rate_{h}")]
    return out


def hit_rates(scored: DataFrame) -> DataFrame:
    """Hit rates overall (ticker NULL) and per ticker, in one pass."""
    return scored.rollup("ticker").agg(*_rates())


def newest_calls(scored: DataFrame, limit: int = K.MAX_CALLS_SHOWN) -> DataFrame:
    return scored.orderBy(F.desc("date"), F.desc("ticker")).limit(limit)


def compute_scoreboard(analyses: DataFrame, prices: DataFrame, now_ms: int) -> dict[str, DataFrame]:
    scored = score_calls(daily_calls(analyses, now_ms - K.SCOREBOARD_DAYS * K.DAY_MS), prices)
    return {"rates": hit_rates(scored), "calls": newest_calls(scored), "scored": scored}
