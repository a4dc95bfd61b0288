"""Further views of the shared test tables: snapshots, analyses, prices, run ledger, logs,
landing lines and a dictionary derived from parts. All rows of the source tables are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..functions import values as V
from ..operators import dedup
from .corpus import CONTEXT_MS, NOW_MS, comments, notes, table

PRICE_SHIFT_DAYS = 8429


def ms_of(ts: Column) -> Column:
    """Epoch milliseconds of a zone-less timestamp, whatever the session zone."""
    return (
        F.unix_date(ts.cast("date")).cast("bigint") * K.DAY_MS + F.hour(ts) * K.HOUR_MS
        + F.minute(ts) * 60_000 + F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("bigint"))


def marked_notes(spark: SparkSession, sf_dir: str, ingested: DataFrame | None = None) -> DataFrame:
    """Notes whose exact copies point at the most liked one (a cheap stand-in for the fingerprint
    pass, which has queries of its own)."""
    n = (notes(spark, sf_dir) if ingested is None else ingested).withColumn("_norm", T.norm_for_hash("note_desc"))
    return dedup.mark_exact(n, "_norm", "note_id", "liked_count", "publish_time_ms", CONTEXT_MS, NOW_MS, source="note_desc").drop("_norm")


def marked_comments(spark: SparkSession, sf_dir: str, ingested: DataFrame | None = None) -> DataFrame:
    return dedup.mark_comments(comments(spark, sf_dir) if ingested is None else ingested, CONTEXT_MS, NOW_MS)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ms", ms_of(F.col("ts")))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    ticker = F.concat(F.upper(F.substring("event_type", 1, 3)), (F.col("user_id") % 6).cast("string"))
    day = F.floor(F.col("ms") / K.DAY_MS) * K.DAY_MS
    return e.groupBy(ticker.alias("ticker"), day.alias("snapped_at_ms")).agg(
        F.lit(None).cast("bigint").alias("run_id"), F.round(F.sum("value"), 2).alias("score"),
        F.count(F.lit(1)).alias("mentions"), F.count_if(F.col("value") < 50).alias("note_count"),
        F.count_if(F.col("value") >= 50).alias("comment_count"))


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    bucket = F.floor(F.col("ms") / (6 * K.HOUR_MS))
    g = e.groupBy(F.concat(F.lit("U"), (F.col("user_id") % 8).cast("string")).alias("ticker"), bucket.alias("bucket")).agg(
        F.count_if(F.col("event_type").isin("purchase", "signup")).alias("bullish"),
        F.count_if(F.col("event_type") == "error").alias("bearish"),
        F.count_if(F.col("event_type") == "view").alias("neutral"),
        F.count(F.lit(1)).alias("n"))
    json = F.to_json(F.struct("bullish", "bearish", "neutral"))
    return g.select(
        "ticker", F.col("bucket").alias("run_id"), (F.col("bucket") * 6 * K.HOUR_MS).alias("generated_at_ms"),
        F.when(F.col("bucket") % 7 == 0, "{bad").otherwise(json).alias("sentiment_counts"),
        F.concat(F.lit("  net "), (F.col("bullish") - F.col("bearish")).cast("string"), F.lit(" ")).alias("summary"),
        F.sha2(F.concat_ws("|", "ticker", F.col("n").cast("string")), 256).alias("input_hash"),
        F.concat(F.lit("m"), (F.col("bucket") % 3).cast("string")).alias("model"),
        (F.col("n") * 1000).alias("input_tokens"), (F.col("n") * 77).alias("output_tokens"),
        F.when(F.col("bucket") % 5 == 0, "no_api_key").when(F.col("bucket") % 11 == 0, "error").otherwise("ok").alias("status"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    ticker = F.concat(F.lit("U"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).cast("string"))
    return o.groupBy(ticker.alias("ticker"), F.date_add(F.col("o_orderdate").cast("date"), PRICE_SHIFT_DAYS).alias("date")).agg(
        F.max("o_totalprice").alias("close"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    k, u = F.col("event_type"), F.col("user_id")
    error = F.when((k == "error") & (u % 10 == 0), "login_required").when(
        (k == "click") & (u % 3 == 0), "stopped after 10 CAPTCHAs")
    return e.select(
        F.col("event_id").alias("id"), F.col("ms").alias("started_at_ms"),
        F.when(k != "view", F.col("ms") + F.floor("value") * 1000).alias("finished_at_ms"),
        error.alias("error"), F.floor("value").alias("requests_est"), (u % 4).alias("notes_fresh"),
        F.when(k == "view", "running").when(error.isNotNull(), "failed").otherwise("success").alias("status"),
        F.when(u % 13 == 0, "expired").when(u % 29 == 0, "unauthorized").otherwise("unknown").alias("log_class"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    t = F.col("turn") % 5
    body = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    kw = F.concat(F.lit("k"), ((F.col("conv_id") + F.col("turn")) % 4).cast("string"))
    line = (
        F.when(F.col("role") == "system", F.concat(F.lit("ValueError: "), body))
        .when(t == 0, F.concat(F.lit("2024-01-01 00:00:0"), F.col("turn").cast("string"), F.lit(" x INFO - Current search keyword: "), kw))
        .when(t == 1, F.concat(F.lit("Begin get note id comments "), body))
        .when(t == 2, F.concat(F.lit("2024-01-01 00:00:02 a ERROR (f.py:1) - "), F.when(F.col("conv_id") % 3 == 0, F.lit("RetryError ")).otherwise(""), body))
        .when(F.col("conv_id") % 2 == 0, F.concat(F.lit("CAPTCHA appeared "), body))
        .otherwise(F.concat(F.when(F.col("conv_id") % 5 == 0, F.lit("ConnectTimeout login expired ")).otherwise(""), body)))
    return c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("lineno"), line.alias("line"))


def log_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    i = F.col("conv_id")
    return c.select(
        i.alias("run_id"), (i % 3).alias("exit_code"), (i % 2).alias("notes_fresh"),
        F.when(i % 4 == 0, "success").when(i % 4 == 1, "running").otherwise("failed").alias("status"))


def planned_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned keywords of each run from a comma list."""
    raw = log_runs(spark, sf_dir).select("run_id", F.lit("k0, k3,,k1 ,k0").alias("keywords"))
    return raw.select("run_id", F.posexplode(V.split_list("keywords")).alias("pos", "keyword"))


def landing_note_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as landing JSON text: mixed time and count formats, some broken lines."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    ms = F.lit(NOW_MS) - (i * 7919 % 10_080) * 60_000
    time = F.when(i % 23 == 0, "soon").when(i % 3 == 0, F.floor(ms / 1000).cast("string")).otherwise(ms.cast("string"))
    liked = F.when(i % 4 == 0, F.concat((i % 90).cast("string"), F.lit(".5万"))).when(
        i % 4 == 1, F.concat((i % 50).cast("string"), F.lit("+"))).when(i % 4 == 2, "1,234").otherwise("none")
    body = F.to_json(F.struct(
        F.when(i % 19 == 0, F.lit("")).otherwise((F.floor(i / 2) * 2).cast("string")).alias("note_id"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("desc"), F.lit("normal").alias("type"),
        time.alias("time"), liked.alias("liked_count"), F.col("source").alias("source_keyword")))
    return d.select(i.alias("line_no"), F.when(i % 31 == 0, F.concat(F.lit("{\"note_id\": "), F.col("lang"))).otherwise(body).alias("value"))


def landing_comment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    i, t = F.col("conv_id"), F.col("turn")
    ms = F.lit(NOW_MS) - (i * 7919 % 10_080) * 60_000 + t * 1000
    body = F.to_json(F.struct(
        F.concat_ws("-", i.cast("string"), t.cast("string")).alias("comment_id"), i.cast("string").alias("note_id"),
        F.when(t > 0, F.concat(i.cast("string"), F.lit("-0"))).alias("parent_comment_id"), F.col("text").alias("content"),
        F.when((i + t) % 37 == 0, F.lit(None)).otherwise(ms).cast("string").alias("create_time"),
        (t * 3).cast("string").alias("like_count")))
    return c.select((i * 1000 + t).alias("line_no"), body.alias("value"))


def part_stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary derived from the part table."""
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    none = F.lit(None).cast("string")
    return p.select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("ticker"), F.col("p_name").alias("name"),
        F.when(F.col("p_type") == "PROMO", K.INDEX_SECTOR).otherwise(F.col("p_type")).alias("sector"),
        F.when(size % 7 == 0, "commodity").when(size % 7 == 1, "crypto").when(size % 7 == 2, "").otherwise(none).alias("asset_class"),
        F.split("p_name", " ").alias("aliases"),
        F.when(size % 2 == 0, F.array("p_brand")).otherwise(F.array().cast("array<string>")).alias("ambiguous"),
        F.array().cast("array<string>").alias("supersedes"),
        F.when(size % 5 == 0, F.concat("p_brand", F.lit("=F"))).alias("quote_symbol"))


def part_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("P"), (F.col("p_partkey") + 500).cast("string")).alias("ticker"), F.lit("overlay").alias("name"),
        F.lit("overlay").alias("sector"), F.lit(None).cast("string").alias("asset_class"),
        F.array(F.lower("p_type"), F.substring_index("p_name", " ", 1)).alias("aliases"),
        F.array("p_brand", F.lit("x")).alias("ambiguous"), F.array().cast("array<string>").alias("supersedes"),
        F.lit(None).cast("string").alias("quote_symbol"))


def customer_tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.concat(F.lit("P"), (F.col("c_custkey") * 2).cast("string")).alias("ticker"), F.col("c_custkey").alias("added_at_ms"),
        F.to_json(F.array(F.col("c_mktsegment"), F.lit(""), F.concat(F.lit("seg "), F.col("c_nationkey").cast("string")))).alias("custom_keywords"))


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias suggestions derived from customers."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"), F.lower("c_mktsegment").alias("term"),
        F.concat(F.lit("P"), (F.col("c_custkey") % 700).cast("string")).alias("guessed_ticker"),
        F.col("c_name").alias("evidence_quote"), (F.col("c_custkey") * 10).alias("suggested_at_ms"),
        F.when(F.col("c_acctbal") < 0, "rejected").otherwise("pending").alias("status"))


def charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart JSON documents, one per customer, from their orders; some closes missing, some broken."""
    o = table(spark, sf_dir, "orders")
    at = F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint") * 86_400 + (F.col("o_orderkey") % 20) * 3600
    rows = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(
        at.alias("t"), F.col("o_orderkey").alias("k"),
        F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice")).alias("c")))).alias("r"))
    doc = F.concat(
        F.lit('{"chart":{"result":[{"meta":{"gmtoffset":'), F.when(F.col("o_custkey") % 2 == 0, "-18000").otherwise("28800"),
        F.lit('},"timestamp":['), F.array_join(F.transform("r", lambda x: x["t"].cast("string")), ","),
        F.lit('],"indicators":{"quote":[{"close":['),
        F.array_join(F.transform("r", lambda x: F.coalesce(x["c"].cast("string"), F.lit("null"))), ","), F.lit("]}]}}]}}"))
    return rows.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"),
                       F.when(F.col("o_custkey") % 41 == 0, F.lit('{"chart": 1}')).otherwise(doc).alias("chart_json"))
