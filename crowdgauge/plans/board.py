"""Read paths: boards payload, compact board, detail of an entity, rating queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import values as V
from ..operators import boards, evidence, matching, ratings, trend
from ..operators.dictionary import Dictionary, classified
from ..operators.tables import latest_usable
from .cycle import non_stocks

# Defaults of arguments: top-k reports.
COMPACT_RADAR = 15
DETAIL_ITEMS = 30


def cards(board: DataFrame, dictionary: Dictionary, now_ms: int, analyses: DataFrame, quotes: DataFrame,
          snapshots: DataFrame) -> DataFrame:
    """Board rows with names, latest analysis, quote, trend and history. Every side has one row
    per entity."""
    d = classified(dictionary.stocks).select("ticker", "name", "sector", "asset_class")
    a = latest_usable(analyses).select("ticker", "sentiment_counts", F.col("status").alias("analysis_status"),
                                       (F.lit(now_ms) - F.col("generated_at_ms")).alias("analysis_age_ms"))
    q = quotes.select("ticker", "price", "change_pct", "market_date", "quoted_at_ms")
    t = trend.compute_trends(snapshots).withColumnRenamed("dir", "trend")
    h = trend.score_history(snapshots, board)
    out = board
    for side in (d, a, q, t, h):
        out = out.join(side, "ticker", "left")
    net = V.lean("sentiment_counts")
    has = F.col("sentiment_counts").isNotNull()
    return out.fillna({"name": "", "sector": "", "asset_class": "stock"}).withColumns({
        "divergence": F.when(has, V.divergence(net, "change_pct")).otherwise(False),
        "latest_item_age_ms": F.when(F.col("latest_item_ms") > 0, F.lit(now_ms) - F.col("latest_item_ms")),
    })


def payload(stats: DataFrame, notes: DataFrame, dictionary: Dictionary, tracked: DataFrame, now_ms: int,
            analyses: DataFrame, quotes: DataFrame, snapshots: DataFrame,
            min_mentions: int = K.MIN_MENTIONS, fresh_ms: int = K.FRESH_HOURS * K.HOUR_MS) -> dict[str, DataFrame]:
    """Everything a board page shows: cards per board, radar, sectors, topics."""
    fresh = stats.filter("window = 'fresh'").drop("window")
    context = stats.filter("window = 'context'").drop("window")
    outside = non_stocks(dictionary)
    board = boards.boards_with_tracked(fresh, dictionary.stocks, tracked, min_mentions)
    radar = boards.context_radar(context, boards.shown(board, tracked, outside))
    names = dictionary.stocks.select("ticker", "name", "sector")
    trends = trend.compute_trends(snapshots).withColumnRenamed("dir", "trend")
    return {
        "cards": cards(board, dictionary, now_ms, analyses, quotes, snapshots),
        "radar": radar.join(names, "ticker", "left").join(trends, "ticker", "left").select(
            "ticker", "name", "sector", "mentions", "score", "top_quote", "trend"),
        "sectors": boards.sector_breakdown(context, dictionary.stocks, outside),
        "topics": matching.topic_breakdown(notes, dictionary, fresh_ms, now_ms),
    }


def compact(fresh: DataFrame, dictionary: Dictionary, min_mentions: int = K.MIN_MENTIONS,
            radar_rows: int = COMPACT_RADAR) -> DataFrame:
    """(section, pos, ticker, …): ranking, indexes, investments and the first radar rows."""
    c = classified(dictionary.stocks)
    outside = non_stocks(dictionary)
    parts = {
        "stocks": boards.ranking(fresh, outside, min_mentions),
        "indexes": boards.class_board(fresh, c.filter("is_index"), min_mentions),
        "investments": boards.class_board(fresh, c.filter("is_investment"), min_mentions),
        "radar": boards.radar(fresh, outside, min_mentions).limit(radar_rows),
    }
    out = None
    for name, df in parts.items():
        rows = df.select(F.lit(name).alias("section"), "ticker", "score", "mentions", "note_count", "comment_count")
        out = rows if out is None else out.unionByName(rows)
    return out.join(dictionary.stocks.select("ticker", "name"), "ticker", "left").fillna({"name": ""})


def rating_queue(fresh: DataFrame, items: DataFrame, dictionary: Dictionary, analyses: DataFrame,
                 min_mentions: int = K.MIN_MENTIONS) -> DataFrame:
    """Entities on a board whose evidence no ok rating covers."""
    cand = boards.candidates(fresh, dictionary.stocks, None, min_mentions)
    extra = classified(dictionary.stocks).select("ticker", "name", "asset_class", "is_index")
    return ratings.pending(cand, evidence.fingerprints(items), analyses).join(extra, "ticker", "left")


def detail_items(items: DataFrame, now_ms: int, rows: int = DETAIL_ITEMS) -> DataFrame:
    return items.filter(F.col("item_no") <= rows).select(
        "ticker", "item_no", "type", "text", "likes", (F.lit(now_ms) - F.col("ts")).alias("age_ms"), "url", "cluster_size")


def detail_topics(items: DataFrame, dictionary: Dictionary, rows: int = DETAIL_ITEMS) -> DataFrame:
    """(ticker, topics): sorted topic tags of the shown items."""
    shown = items.filter(F.col("item_no") <= rows).select("ticker", "item_no", "text")
    return matching.topic_hits(shown, dictionary, ["ticker", "item_no"]).groupBy("ticker").agg(
        F.array_sort(F.collect_set("tag")).alias("topics"))


def detail(ticker: str, items: DataFrame, dictionary: Dictionary, analyses: DataFrame, now_ms: int) -> dict[str, DataFrame]:
    """Detail page of one entity."""
    t = ticker.upper()
    if not (t.isascii() and t.isalpha() and 1 <= len(t) <= 5):
        raise ValueError(f"invalid ticker: {ticker!r}")
    own = items.filter(F.col("ticker") == t)
    strings = "array<string>"
    last = latest_usable(analyses.filter(F.col("ticker") == t))
    decoded = last.withColumns({
        "sentiment_counts": V.sentiment("sentiment_counts"), "bull_points": F.from_json("bull_points", strings),
        "bear_points": F.from_json("bear_points", strings), "notable_quotes": F.from_json("notable_quotes", strings),
        "age_ms": F.lit(now_ms) - F.col("generated_at_ms")})
    return {"items": detail_items(own, now_ms), "topics": detail_topics(own, dictionary), "analysis": decoded}
