"""Snapshots, trends, history, keyed tables, retention."""

from pyspark.sql import functions as F

from crowdgauge import constants as K
from crowdgauge.operators import tables as TB
from crowdgauge.operators import trend as TR

from .base import Registry

Q = Registry()


@Q.add("a17_snapshots", "snaps", "SELECT ticker, snapped_at_ms, score, mentions FROM snaps WHERE snapped_at_ms // 86400000 % 2 = 1")
def _(t):
    s = t.snapshots
    return TR.new_snapshots(s.filter(F.floor(F.col("snapped_at_ms") / K.DAY_MS) % 2 == 0), s.unionByName(s)).select("ticker", "snapped_at_ms", "score", "mentions")


@Q.add("a17_snapshot_rows", "stats", "SELECT ticker, 5::BIGINT AS run_id, 99::BIGINT AS snapped_at_ms, score, mentions FROM stats")
def _(t):
    return TR.snapshot_rows(t.stats, 5, 99).select("ticker", "run_id", "snapped_at_ms", "score", "mentions")


@Q.add("w03_last_cycles", "snaps", "SELECT DISTINCT snapped_at_ms FROM snaps ORDER BY 1 DESC LIMIT 2")
def _(t):
    return TR.last_cycles(t.snapshots, 2)


PAIR = """WITH c AS (SELECT DISTINCT snapped_at_ms AS m FROM snaps ORDER BY 1 DESC LIMIT 2),
  j AS (SELECT n.ticker, n.score, p.score AS p FROM snaps n LEFT JOIN snaps p ON p.ticker = n.ticker AND p.snapped_at_ms = (SELECT min(m) FROM c)
        WHERE n.snapped_at_ms = (SELECT max(m) FROM c))"""


@Q.add("w04_trends", "snaps", PAIR + """ SELECT ticker, CASE WHEN p IS NULL THEN 'new' WHEN p > 0 AND (score - p) / p * 100 >= 25 AND score - p >= 2 THEN 'up'
  WHEN p > 0 AND (score - p) / p * 100 <= -25 AND p - score >= 2 THEN 'down' ELSE 'flat' END AS dir,
  CASE WHEN p >= 5 THEN CAST(round_even((score - p) / p * 100, 0) AS BIGINT) END AS delta_pct, coalesce(p, 0.0) AS prev_score FROM j""")
def _(t):
    return TR.compute_trends(t.snapshots)


@Q.add("j10_latest_vs_previous", "snaps", PAIR + " SELECT ticker, coalesce(p, 0.0) AS prev_score, p IS NULL AS is_new FROM j")
def _(t):
    return TR.compute_trends(t.snapshots).select("ticker", "prev_score", (F.col("dir") == "new").alias("is_new"))


SPINE = """SELECT k.ticker, c.m AS snapped_at_ms, coalesce(s.score, 0.0) AS score FROM (SELECT DISTINCT ticker FROM snaps UNION SELECT 'QUIET') k,
  (SELECT DISTINCT snapped_at_ms AS m FROM snaps ORDER BY 1 DESC LIMIT 10) c LEFT JOIN snaps s ON s.ticker = k.ticker AND s.snapped_at_ms = c.m"""


def asked(t):
    return t.snapshots.select("ticker").union(t.raw("region").select(F.lit("QUIET")))


@Q.add("j11_zero_filled_spine", "snaps", SPINE)
def _(t):
    return TR.history_rows(t.snapshots, asked(t), 10)


@Q.add("w05_score_history", "snaps", f"SELECT ticker, string_agg(snapped_at_ms || ':' || round(score)::BIGINT, ',' ORDER BY snapped_at_ms) AS history FROM ({SPINE}) GROUP BY 1")
def _(t):
    h = TR.score_history(t.snapshots, asked(t), 10)
    return h.select("ticker", F.array_join(F.transform("history", lambda x: F.concat(
        x["ts"].cast("string"), F.lit(":"), F.round(x["score"]).cast("bigint").cast("string"))), ",").alias("history"))


@Q.add("w01_latest_row", "ana", "SELECT ticker, generated_at_ms, status FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY generated_at_ms DESC) AS rn FROM ana) WHERE rn = 1")
def _(t):
    return TB.latest(t.analyses, ["ticker"], F.struct("generated_at_ms", "run_id")).select("ticker", "generated_at_ms", "status")


@Q.add("w02_latest_usable", "ana", """SELECT ticker, generated_at_ms, status FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY status = 'error', rn) AS pick FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY generated_at_ms DESC) AS rn FROM ana) WHERE rn <= 5) WHERE pick = 1""")
def _(t):
    return TB.latest_usable(t.analyses).select("ticker", "generated_at_ms", "status")


@Q.add("a05_upsert", "ev", """SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id, min(ms) AS first_ms FROM ev GROUP BY 1""")
def _(t):
    e = t.events.select("user_id", "event_type", "event_id", F.col("ms").alias("first_ms"))
    half = t.events.agg((F.max("event_id") / 2).alias("h")).scalar()
    e = e.withColumn("_h", half)
    return TB.upsert(e.filter("event_id < _h").drop("_h"), e.filter("event_id >= _h").drop("_h"), ["user_id"], "event_id", preserve=["first_ms"])


def swept(t):
    age = F.col("publish_time_ms") - (F.col("note_id").cast("bigint") % 12) * K.DAY_MS
    n = t.notes.withColumn("publish_time_ms", age)
    c = t.comments.withColumn("create_time_ms", F.col("create_time_ms") - (F.length("content") % 12) * K.DAY_MS)
    a = t.analyses.withColumn("generated_at_ms", F.col("generated_at_ms") - 10 * K.DAY_MS)
    return TB.sweep({"notes": n, "comments": c, "analyses": a, "snapshots": t.snapshots, "runs": t.runs}, t.now + 2 * K.DAY_MS)


NOW2 = 1706572800000 + 2 * K.DAY_MS
WEEK, MONTH = NOW2 - 7 * K.DAY_MS, NOW2 - 30 * K.DAY_MS


@Q.add("a15_retention", "notes0 comments0 ana snaps ledger", f"""
  WITH c AS (SELECT *, create_time_ms - (length(content) % 12) * 86400000 AS at_ms FROM comments0), ck AS (SELECT * FROM c WHERE at_ms >= {WEEK}),
  n AS (SELECT *, publish_time_ms - (CAST(note_id AS BIGINT) % 12) * 86400000 AS at_ms FROM notes0)
  SELECT 'comments' AS tbl, comment_id AS id FROM ck
  UNION ALL SELECT 'notes', note_id FROM n WHERE at_ms >= {WEEK} OR note_id IN (SELECT note_id FROM ck)
  UNION ALL SELECT 'analyses', ticker || run_id FROM ana WHERE generated_at_ms - 864000000 >= {MONTH}
  UNION ALL SELECT 'snapshots', ticker || snapped_at_ms FROM snaps WHERE snapped_at_ms >= {MONTH}
  UNION ALL SELECT 'runs', CAST(id AS VARCHAR) FROM ledger WHERE started_at_ms >= {MONTH}""")
def _(t):
    s = swept(t)
    key = {"comments": F.col("comment_id"), "notes": F.col("note_id"), "analyses": F.concat("ticker", F.col("run_id").cast("string")),
           "snapshots": F.concat("ticker", F.col("snapped_at_ms").cast("string")), "runs": F.col("id").cast("string")}
    out = None
    for name, id_ in key.items():
        rows = s[name].select(F.lit(name).alias("tbl"), id_.alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out


@Q.add("a16_price_retention", "px", "SELECT ticker, CAST(date AS VARCHAR) AS date FROM px WHERE date >= DATE '2024-01-30' - 60")
def _(t):
    return TB.sweep_prices(t.prices, "2024-01-30").select("ticker", F.col("date").cast("string").alias("date"))


@Q.add("q08_enum_violations", "ana", "SELECT ticker, run_id FROM ana WHERE status NOT IN ('ok', 'error')")
def _(t):
    return TB.enum_violations(t.analyses, "status", ("ok", "error")).select("ticker", "run_id")


@Q.add("s10_recent_runs", "ledger", "SELECT id, started_at_ms FROM ledger ORDER BY id DESC LIMIT 500")
def _(t):
    return TB.recent_runs(t.runs, 500).select("id", "started_at_ms")


@Q.add("g19_usage_cost", "ana", """SELECT model, CAST(CAST(to_timestamp(generated_at_ms / 1000) AT TIME ZONE 'UTC' AS DATE) AS VARCHAR) AS day, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(round((input_tokens * 0.14 + output_tokens * 0.28) / 1e6, 6)), 6) AS cost_usd FROM ana GROUP BY 1, 2""")
def _(t):
    from crowdgauge.operators.ledger import usage_by_model
    return usage_by_model(t.analyses).withColumn("day", F.col("day").cast("string"))
