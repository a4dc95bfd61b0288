"""Boards, radar, sectors, candidate budgets. Input is one row per entity, so these are small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from .dictionary import classified

ZEROS = {"score": 0.0, "mentions": 0, "note_count": 0, "comment_count": 0, "note_count_raw": 0,
         "comment_count_raw": 0, "focused_mentions": 0, "latest_item_ms": 0}


def is_rankable(min_mentions: int = K.MIN_MENTIONS) -> Column:
    return (F.col("mentions") >= min_mentions) & (F.col("focused_mentions") >= 1)


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    return df.orderBy(*order, "ticker")


def ranking(stats: DataFrame, non_stocks: DataFrame, min_mentions: int = K.MIN_MENTIONS) -> DataFrame:
    stocks = stats.join(non_stocks.select("ticker"), "ticker", "left_anti")
    return ranked(stocks.filter(is_rankable(min_mentions)), F.desc("score"))


def radar(stats: DataFrame, non_stocks: DataFrame, min_mentions: int = K.MIN_MENTIONS) -> DataFrame:
    stocks = stats.join(non_stocks.select("ticker"), "ticker", "left_anti")
    return ranked(stocks.filter((F.col("mentions") >= 1) & ~is_rankable(min_mentions)),
                  F.desc("mentions"), F.desc("score"))


def class_board(stats: DataFrame, members: DataFrame, min_mentions: int = K.MIN_MENTIONS) -> DataFrame:
    """Board of an entity class: enough mentions, no focus gate."""
    inside = stats.join(members.select("ticker"), "ticker", "left_semi")
    return ranked(inside.filter(F.col("mentions") >= min_mentions), F.desc("score"))


def context_radar(stats: DataFrame, shown: DataFrame) -> DataFrame:
    """Everything mentioned in the wide window that no board shows."""
    rest = stats.filter("mentions >= 1").join(shown.select("ticker").distinct(), "ticker", "left_anti")
    return ranked(rest, F.desc("mentions"), F.desc("score"))


def sector_breakdown(stats: DataFrame, stocks: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Share of the score per sector with its leading entity."""
    rows = stats.filter("mentions >= 1")
    if exclude is not None:
        rows = rows.join(exclude.select("ticker"), "ticker", "left_anti")
    named = F.when(F.col("sector") != "", F.col("sector"))
    rows = rows.join(stocks.select("ticker", "sector"), "ticker", "left").withColumn(
        "sector", F.coalesce(named, F.lit(K.OTHER_SECTOR)))
    agg = rows.groupBy("sector").agg(
        F.sum("score").alias("raw"), F.sum("mentions").alias("mentions"),
        F.count(F.lit(1)).alias("tickers"),
        F.min_by("ticker", F.struct(-F.col("score"), F.col("ticker"))).alias("leader"),
        F.max("score").alias("leader_score"),
    )
    total = F.sum("raw").over(Window.partitionBy(F.lit(1)))
    score = F.round("raw", 2)
    return agg.select(
        "sector", score.alias("score"), "mentions", "tickers", "leader", "leader_score",
        F.when(total != 0, F.round(score / total * 100, 1)).otherwise(0.0).alias("share"),
    ).orderBy(F.desc("score"), "sector")


def candidates(stats: DataFrame, stocks: DataFrame, tracked: DataFrame | None = None,
               min_mentions: int = K.MIN_MENTIONS, quota: dict[str, int] | None = None) -> DataFrame:
    """Entities to analyse: a budget per kind, then tracked ones with at least one mention."""
    quota = quota or {"stock": K.MAX_STOCKS, "index": K.MAX_INDEXES, "investment": K.MAX_INVESTMENTS}
    kind = F.when(F.col("is_index"), "index").when(F.col("is_investment"), "investment").otherwise("stock")
    flags = classified(stocks).select("ticker", "is_index", "is_investment")
    rows = stats.join(flags, "ticker", "left").withColumn(
        "kind", F.coalesce(F.when(F.col("is_index").isNull(), F.lit("stock")), kind))
    fit = F.when(F.col("kind") == "stock", is_rankable(min_mentions)).otherwise(
        F.col("mentions") >= min_mentions)
    limit = F.lit(0)
    order = F.lit(3)
    for i, (name, n) in enumerate(quota.items()):
        limit = F.when(F.col("kind") == name, n).otherwise(limit)
        order = F.when(F.col("kind") == name, i).otherwise(order)
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), "ticker"))
    top = rows.filter(fit).withColumn("rank", rank).filter(F.col("rank") <= limit).select(
        order.alias("section"), "rank", "ticker", "kind", "score", "mentions")
    if tracked is None:
        return top.orderBy("section", "rank")
    extra = rows.join(tracked.select("ticker"), "ticker", "left_semi").filter("mentions >= 1").join(
        top.select("ticker"), "ticker", "left_anti").withColumn(
        "rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("ticker"))
    ).select(F.lit(3).alias("section"), "rank", "ticker", "kind", "score", "mentions")
    return top.unionByName(extra).orderBy("section", "rank")


def boards_with_tracked(stats: DataFrame, stocks: DataFrame, tracked: DataFrame,
                        min_mentions: int = K.MIN_MENTIONS) -> DataFrame:
    """All boards in one table: (board, ticker, …stats, tracked, shown_by).

    A tracked entity always shows, with zeros if it was not mentioned, on its own board.
    """
    flags = classified(stocks).select("ticker", "is_index", "is_investment")
    both = stats.join(
        tracked.select("ticker", F.lit(True).alias("tracked")).distinct(), "ticker", "full_outer"
    ).join(flags, "ticker", "left").fillna(ZEROS).fillna(
        {"tracked": False, "is_index": False, "is_investment": False})
    board = F.when(F.col("is_investment"), "investments").when(
        F.col("is_index"), "indexes").otherwise("ranking")
    ok = F.when(board == "ranking", is_rankable(min_mentions)).otherwise(
        F.col("mentions") >= min_mentions)
    return both.withColumns({"board": board, "qualified": ok}).filter(
        F.col("qualified") | F.col("tracked")).drop("is_index", "is_investment")


def shown(boards: DataFrame, *others: DataFrame) -> DataFrame:
    """Distinct tickers of several tables."""
    out = boards.select("ticker")
    for o in others:
        out = out.union(o.select("ticker"))
    return out.distinct()


def chart_rows(stats: DataFrame, analyses: DataFrame, now_ms: int, stale_hours: int = 6) -> DataFrame:
    """Rows for a chart: zero-mention rows dropped, score ascending, sentiment sign, stale flag."""
    from ..functions import values as V

    s = V.sentiment("sentiment_counts")
    return stats.filter("mentions > 0").join(analyses, "ticker", "left").select(
        "ticker", "score", "mentions",
        V.sentiment_sign(F.coalesce(s["bullish"], F.lit(0)), F.coalesce(s["bearish"], F.lit(0))).alias("sign"),
        F.coalesce(F.lit(now_ms) - F.col("generated_at_ms") > stale_hours * K.HOUR_MS,
                   F.lit(False)).alias("stale"),
    ).orderBy("score", "ticker")
