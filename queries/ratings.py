"""Ratings: validation, sink rows, currency, intake, queue, staging, usage split, rater."""

from pyspark.sql import functions as F

from crowdgauge.operators import evidence as E
from crowdgauge.operators import ratings as R

from .base import Registry

Q = Registry()


@Q.add("m08_reply_validation", "", """SELECT event_id, event_type <> 'error' AS valid, CASE WHEN event_type <> 'error' THEN user_id % 7 ELSE 0 END AS bullish, 0::BIGINT AS bearish FROM events""")
def _(t):
    u = (F.col("user_id") % 7).cast("string")
    reply = F.when(F.col("event_type") == "error", F.concat(F.lit("{\"k\": "), u, F.lit("}"))).otherwise(
        F.concat(F.lit("{\"summary\": \"s\", \"sentiment_counts\": {\"bullish\": "), u, F.lit("}}")))
    r = R.parse_reply(reply)
    return t.raw("events").select("event_id", r.isNotNull().alias("valid"), F.coalesce(r["bullish"], F.lit(0)).alias("bullish"), F.coalesce(r["bearish"], F.lit(0)).alias("bearish"))


@Q.add("m08_batch_complete", "ana", """SELECT run_id AS batch_id, count(*) = 8 AND run_id % 3 <> 0 AS complete FROM ana GROUP BY 1""")
def _(t):
    a = t.analyses
    requested = a.select(F.col("run_id").alias("batch_id")).distinct().select("batch_id", F.explode(F.array(*[F.lit(f"U{i}") for i in range(8)])).alias("ticker"))
    replies = a.select(F.col("run_id").alias("batch_id"), F.lower("ticker").alias("ticker"))
    extra = replies.filter("batch_id % 3 = 0 AND ticker = 'u0'")
    return R.batch_is_complete(replies.unionByName(extra), requested)


@Q.add("a13_analysis_rows", "prints stats", """SELECT p.ticker, p.note_count, p.item_count - p.note_count AS comment_count, s.score AS popularity_score,
  '{"bullish":3,"bearish":1,"neutral":0}' AS sentiment_counts, p.ticker || ': fine day' AS summary, '["a","b","c","d"]' AS bull_points, p.input_hash, 'ok' AS status,
  p.item_count * 100 AS input_tokens, p.item_count * 7 AS output_tokens, round((p.item_count * 100 * 0.14::DOUBLE + p.item_count * 7 * 0.28::DOUBLE) / 1e6, 6) AS cost_usd, CAST(NULL AS VARCHAR) AS error
  FROM prints p JOIN stats s ON s.ticker = p.ticker
  UNION ALL SELECT ticker, note_count, item_count - note_count, 0.0, NULL, NULL, NULL, input_hash, 'error', NULL, NULL, NULL, 'no reply for ' || ticker FROM prints WHERE item_count % 2 = 1""")
def _(t):
    items, stats = t.items, t.stats
    k = items.select("ticker").distinct().select("ticker", F.lit(
        '{"summary": " fine day ", "sentiment_counts": {"bullish": 3, "bearish": 1}, "bull_points": ["a","b","c","d","e"], "notable_quote_ids": [2, 1, 2]}').alias("reply"))
    ratings = k.select("ticker", R.parse_reply("reply").alias("r")).select("ticker", "r.*")
    prints = E.fingerprints(items)
    usage = prints.select("ticker", (F.col("item_count") * 100).alias("input_tokens"), (F.col("item_count") * 7).alias("output_tokens"))
    failed = prints.filter("item_count % 2 = 1").select("ticker", F.concat(F.lit("no reply for "), "ticker").alias("error"))
    rows = R.analysis_rows(ratings, items, t.now, t.context, stats, usage=usage).unionByName(R.error_rows(failed, items, t.now, t.context), allowMissingColumns=True)
    return rows.select("ticker", "note_count", "comment_count", "popularity_score", "sentiment_counts", "summary", "bull_points", "input_hash", "status",
                       "input_tokens", "output_tokens", "cost_usd", "error")


LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY generated_at_ms DESC) AS rn FROM ana) WHERE rn = 1"


@Q.add("c09_is_current", "ana", f"""WITH l AS ({LAST}), e AS (SELECT ticker, min(input_hash) AS input_hash FROM ana GROUP BY 1 UNION ALL SELECT ticker, input_hash FROM l)
  SELECT e.ticker, e.input_hash, e.input_hash = l.input_hash AND l.status IN ('ok', 'no_api_key') AS current FROM e JOIN l ON l.ticker = e.ticker""")
def _(t):
    a = t.analyses
    first = a.groupBy("ticker").agg(F.min("input_hash").alias("input_hash"))
    last = a.groupBy("ticker").agg(F.max_by("input_hash", "generated_at_ms").alias("input_hash"))
    return R.is_current(first.unionByName(last), a)


@Q.add("c11_rating_intake", "prints stocks", """SELECT ticker, outcome FROM (SELECT ticker, 'ok' AS outcome FROM prints UNION ALL SELECT ticker, 'stale_evidence' FROM prints
  UNION ALL SELECT ticker, 'no_items' FROM stocks WHERE ticker NOT IN (SELECT ticker FROM prints))""")
def _(t):
    p = E.fingerprints(t.items)
    subs = p.select("ticker", F.explode(F.array("evidence_hash", "input_hash")).alias("evidence_hash"))
    none = t.dictionary.stocks.select("ticker").join(p.select("ticker"), "ticker", "left_anti").withColumn("evidence_hash", F.lit("x"))
    return R.intake(subs.unionByName(none), p).select("ticker", "outcome")


def history(t, items):
    """Earlier analyses of half of the entities on today's evidence."""
    return E.fingerprints(items).filter(F.ascii(F.substring("ticker", 2, 1)) % 2 == 0).select(
        "ticker", F.lit(None).cast("bigint").alias("run_id"), F.lit(t.now - 3_600_000).alias("generated_at_ms"), "input_hash",
        F.when(F.ascii("ticker") % 2 == 0, "ok").otherwise("no_api_key").alias("status"), F.concat(F.lit(" about "), "ticker").alias("summary"))


EVEN, OK = "ascii(substr(ticker, 2, 1)) % 2 = 0", "ascii(ticker) % 2 = 0"


@Q.add("c08_pending_ratings", "prints stats classes", f"""
  WITH k AS (SELECT s.ticker, s.score, CASE WHEN c.is_index THEN 'index' WHEN c.is_investment THEN 'investment' ELSE 'stock' END AS kind, s.focused_mentions, s.mentions FROM stats s LEFT JOIN classes c ON c.ticker = s.ticker),
  b AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, ticker) AS rank FROM k WHERE mentions >= 2 AND (kind <> 'stock' OR focused_mentions >= 1))
  SELECT k.ticker, CASE kind WHEN 'stock' THEN 0 WHEN 'index' THEN 1 ELSE 2 END AS section, CAST(rank AS INT) AS rank, score, p.item_count AS evidence_items FROM b k JOIN prints p ON p.ticker = k.ticker
  WHERE rank <= CASE kind WHEN 'stock' THEN 15 WHEN 'index' THEN 3 ELSE 5 END AND NOT ({EVEN.replace('ticker', 'k.ticker')} AND {OK.replace('ticker', 'k.ticker')})""")
def _(t):
    from crowdgauge.plans.board import rating_queue
    items = t.items
    return rating_queue(t.stats, items, t.dictionary, history(t, items)).select("ticker", "section", "rank", "score", "evidence_items")


@Q.add("c17_staging", "prints stocks", f"""SELECT ticker, CASE WHEN {EVEN} THEN 'skipped_unchanged' ELSE 'prepared' END AS state,
    CASE WHEN NOT ({EVEN}) AND item_count % 3 <> 0 THEN 'earlier of ' || ticker END AS prev_summary FROM prints
  UNION ALL SELECT ticker, 'no_items', NULL FROM stocks WHERE ticker NOT IN (SELECT ticker FROM prints)""")
def _(t):
    items = t.items
    p = E.fingerprints(items)
    cand = p.select("ticker").unionByName(t.dictionary.stocks.select("ticker").join(p.select("ticker"), "ticker", "left_anti"))
    # An ok rating on other evidence: of today, or of three days ago and too old to be told.
    hours = F.when(F.col("item_count") % 3 == 0, 72).otherwise(2)
    moved = p.select("ticker", F.lit(None).cast("bigint").alias("run_id"), (F.lit(t.now) - hours * 3_600_000).alias("generated_at_ms"),
                     F.lit("moved").alias("input_hash"), F.lit("ok").alias("status"), F.concat(F.lit(" earlier of "), "ticker").alias("summary"))
    return R.staged(cand, p, history(t, items).unionByName(moved), t.now).select("ticker", "state", "prev_summary")


@Q.add("c12_fallback_rows", "items", f"""SELECT ticker, 'no_api_key' AS status, string_agg(text, ' | ' ORDER BY quote_no) AS notable_quotes FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY substance < 20, aside, fanout, likes DESC, item_no) AS quote_no, max(substance) OVER (PARTITION BY ticker) AS best FROM items)
  WHERE quote_no <= 3 AND (substance >= 20 OR best < 20) AND NOT ({EVEN} AND {OK}) GROUP BY 1""")
def _(t):
    items = t.items
    return R.fallback_rows(items, history(t, items)).select(
        "ticker", "status", F.array_join(F.from_json("notable_quotes", "array<string>"), " | ").alias("notable_quotes"))


@Q.add("g18_usage_allocation", "", """
  WITH w AS (SELECT l_orderkey AS group_id, l_partkey * 100 + l_linenumber AS idx, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS weight FROM lineitem GROUP BY 1, 2),
  s AS (SELECT w.*, sum(weight) OVER (PARTITION BY group_id)::BIGINT AS ws, 1000 + group_id % 977 AS total FROM w),
  b AS (SELECT *, total * weight // ws AS base, total * weight % ws AS rem FROM s)
  SELECT group_id, idx, base + CASE WHEN row_number() OVER (PARTITION BY group_id ORDER BY rem DESC, idx) <= total - sum(base) OVER (PARTITION BY group_id) THEN 1 ELSE 0 END AS allocated FROM b""")
def _(t):
    w = t.raw("lineitem").groupBy(F.col("l_orderkey").alias("group_id"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("idx")).agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("weight"))
    total = w.select("group_id").distinct().withColumn("total", 1000 + F.col("group_id") % 977)
    return R.allocate(total, w).select("group_id", "idx", "allocated")


@Q.add("u01_rater", "items", """SELECT ticker, count(*) AS total FROM items GROUP BY 1""")
def _(t):
    r = R.rate(t.items).select("ticker", R.parse_reply("reply").alias("r"))
    return r.select("ticker", (F.col("r.bullish") + F.col("r.bearish") + F.col("r.neutral")).alias("total"))


@Q.add("f16_previous_summary", "ana", """SELECT ticker, arg_max(trim(summary), generated_at_ms) AS prev_summary FROM ana WHERE status = 'ok' AND generated_at_ms >= 1706572800000 - 172800000 GROUP BY 1""")
def _(t):
    return E.previous_summaries(t.analyses, t.now)
