"""Price charts, history, quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import upsert

CHART_SCHEMA = (
    "chart struct<result:array<struct<timestamp:array<bigint>,"
    "indicators:struct<quote:array<struct<close:array<double>>>>,meta:struct<gmtoffset:bigint>>>>"
)


def parse_charts(charts: DataFrame, ticker: str = "ticker", doc: str = "chart_json") -> DataFrame:
    """Chart documents to (ticker, date, close): one row per local day of the exchange, the last
    close of the day wins; malformed documents give no rows."""
    r = F.from_json(F.col(doc), CHART_SCHEMA)["chart"]["result"][0]
    parts = charts.select(
        F.col(ticker).alias("ticker"), r["timestamp"].alias("ts"),
        r["indicators"]["quote"][0]["close"].alias("closes"),
        F.coalesce(r["meta"]["gmtoffset"], F.lit(0)).alias("offset"))
    n = F.least(F.size("ts"), F.size("closes"))
    pairs = F.slice(F.arrays_zip("ts", "closes"), F.lit(1), n)
    rows = parts.filter(F.col("ts").isNotNull() & F.col("closes").isNotNull() & (n > 0)).select(
        "ticker", "offset", F.posexplode(pairs).alias("pos", "p")
    ).filter(F.col("p.closes").isNotNull() & F.col("p.ts").isNotNull())
    day = F.date_add(F.lit("1970-01-01").cast("date"),
                     F.floor((F.col("p.ts") + F.col("offset")) / 86_400).cast("int"))
    return rows.groupBy("ticker", day.alias("date")).agg(
        F.round(F.max_by("p.closes", "pos"), 4).alias("close"))


def store_closes(history: DataFrame, closes: DataFrame) -> DataFrame:
    return upsert(history, closes, ["ticker", "date"], "date")


def latest_quotes(closes: DataFrame, quoted_at_ms: int) -> DataFrame:
    """Last and previous close and the change per ticker; no change without a previous close."""
    newest = Window.partitionBy("ticker").orderBy(F.desc("date"))
    two = closes.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= 2)
    q = two.groupBy("ticker").agg(
        F.max(F.when(F.col("_rn") == 1, F.col("close"))).alias("price"),
        F.max(F.when(F.col("_rn") == 2, F.col("close"))).alias("prev_close"),
        F.max("date").alias("market_date"))
    change = F.when(F.col("prev_close") != 0, F.round(
        (F.col("price") - F.col("prev_close")) / F.col("prev_close") * 100, 2))
    return q.select("ticker", "price", "prev_close", change.alias("change_pct"), "market_date",
                    F.lit(quoted_at_ms).alias("quoted_at_ms"))


def with_previous(closes: DataFrame) -> DataFrame:
    """Every close with the close before it. One ticker has at most one row per day."""
    by_day = Window.partitionBy("ticker").orderBy("date")
    return closes.withColumn("prev_close", F.lag("close").over(by_day))


def need_refresh(requested: DataFrame, quotes: DataFrame, now_ms: int, max_age_ms: int) -> DataFrame:
    """One row (need_refresh, missing, stale): is any requested quote missing or too old?"""
    j = requested.select("ticker").distinct().join(quotes.select("ticker", "quoted_at_ms"), "ticker", "left")
    missing = F.col("quoted_at_ms").isNull()
    stale = F.coalesce(F.lit(now_ms) - F.col("quoted_at_ms") > max_age_ms, F.lit(False))
    return j.agg(
        F.coalesce(F.bool_or(missing | stale), F.lit(False)).alias("need_refresh"),
        F.count_if(missing).alias("missing"), F.count_if(stale).alias("stale"))


def quotes_of(requested: DataFrame, quotes: DataFrame) -> DataFrame:
    return quotes.join(requested.select("ticker").distinct(), "ticker", "left_semi")
