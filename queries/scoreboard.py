"""As-of joins, calls, hit rates, charts, quotes."""

from pyspark.sql import functions as F

from crowdgauge.operators import prices as P
from crowdgauge.operators import scoreboard as SB
from crowdgauge.operators.asof import asof_join, day_number

from .base import Registry
from .sqlparts import part

Q = Registry()
SINCE = 1706572800000 - 30 * 86_400_000
part("calls", "ana", f"""
  SELECT ticker, date, net, CASE WHEN net > 0 THEN 'up' ELSE 'down' END AS dir FROM (
    SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY generated_at_ms DESC) AS rn FROM (
      SELECT ticker, generated_at_ms, DATE '1970-01-01' + CAST(generated_at_ms // 86400000 AS INT) AS date, bull - bear AS net FROM ana
      WHERE status = 'ok' AND run_id % 7 <> 0 AND generated_at_ms >= {SINCE} AND abs(bull - bear) >= 2)) WHERE rn = 1""")
part("scored", "calls px", """
  SELECT b.*, CASE WHEN base_close <> 0 THEN round((n1 - base_close) / base_close * 100, 2) END AS m1, CASE WHEN base_close <> 0 THEN round((n7 - base_close) / base_close * 100, 2) END AS m7 FROM (
    SELECT c.*, (SELECT arg_min(close, date) FROM px p WHERE p.ticker = c.ticker AND p.date > c.base_date) AS n1,
           (SELECT arg_min(close, date) FROM px p WHERE p.ticker = c.ticker AND p.date >= c.base_date + 7) AS n7 FROM (
      SELECT c.*, (SELECT max(date) FROM px p WHERE p.ticker = c.ticker AND p.date <= c.date) AS base_date,
             (SELECT arg_max(close, date) FROM px p WHERE p.ticker = c.ticker AND p.date <= c.date) AS base_close FROM calls c) c) b""")
OUT = """SELECT ticker, CAST(date AS VARCHAR) AS date, dir, net, m1 AS move_1d_pct, CASE WHEN m1 = 0 THEN false ELSE (m1 > 0) = (dir = 'up') END AS correct_1d,
  m7 AS move_7d_pct, CASE WHEN m7 = 0 THEN false ELSE (m7 > 0) = (dir = 'up') END AS correct_7d FROM scored"""


def scored(t):
    return SB.score_calls(SB.daily_calls(t.analyses, SINCE), t.prices)


@Q.add("g14_daily_calls", "calls", "SELECT ticker, CAST(date AS VARCHAR) AS date, net, dir FROM calls")
def _(t):
    return SB.daily_calls(t.analyses, SINCE).withColumn("date", F.col("date").cast("string"))


@Q.add("j12_asof_backward", "calls px", """SELECT ticker, CAST(date AS VARCHAR) AS date, (SELECT arg_max(close, date) FROM px p WHERE p.ticker = c.ticker AND p.date <= c.date) AS base_close FROM calls c""")
def _(t):
    return SB.baseline(SB.daily_calls(t.analyses, SINCE), t.prices).select("ticker", F.col("date").cast("string").alias("date"), "base_close")


def forward(t, shift, strict):
    o = t.raw("orders").select("o_orderkey", F.concat(F.lit("U"), (F.col("o_custkey") % 6).cast("string")).alias("ticker"),
                               (F.unix_date(F.col("o_orderdate").cast("date")) + 8429 + shift).alias("day"))
    p = t.prices.select("ticker", day_number("date").alias("day"), "close")
    return asof_join(o, p, ["ticker"], "day", "day", ["close"], forward=True, allow_equal=not strict, prefix="next_").select("o_orderkey", "next_close")


FWD = """SELECT o_orderkey, close AS next_close FROM (SELECT o_orderkey, 'U' || (o_custkey % 6) AS ticker, CAST(o_orderdate AS DATE) + 8429 + {} AS d FROM orders) o
  ASOF LEFT JOIN px p ON p.ticker = o.ticker AND o.d {} p.date"""


@Q.add("j13_asof_forward", "px", FWD.format(0, "<"))
def _(t):
    return forward(t, 0, True)


@Q.add("j14_asof_forward_week", "px", FWD.format(7, "<="))
def _(t):
    return forward(t, 7, False)


@Q.add("g13_scored_calls", "scored", OUT)
def _(t):
    return scored(t).withColumn("date", F.col("date").cast("string"))


@Q.add("g13_newest_calls", "scored", OUT + " ORDER BY date DESC, ticker DESC LIMIT 50")
def _(t):
    return SB.newest_calls(scored(t)).withColumn("date", F.col("date").cast("string"))


@Q.add("g12_hit_rates", "scored", f"""WITH o AS ({OUT}) SELECT ticker, count(*) AS calls, count(correct_1d) AS evaluated_1d, count(*) FILTER (correct_1d) AS correct_1d,
  round(count(*) FILTER (correct_1d) / nullif(count(correct_1d), 0) * 100, 1) AS hit_rate_1d, count(correct_7d) AS evaluated_7d, count(*) FILTER (correct_7d) AS correct_7d,
  round(count(*) FILTER (correct_7d) / nullif(count(correct_7d), 0) * 100, 1) AS hit_rate_7d FROM o GROUP BY ROLLUP (ticker)""")
def _(t):
    return SB.hit_rates(scored(t))


part("bars", "", """SELECT ticker, DATE '1970-01-01' + CAST((ts + off) // 86400 AS INT) AS date, round(arg_max(c, (ts, k)), 4) AS close FROM (
  SELECT 'C' || o_custkey AS ticker, o_orderkey AS k, (CAST(o_orderdate AS DATE) - DATE '1970-01-01') * 86400 + (o_orderkey % 20) * 3600 AS ts, o_totalprice AS c,
         CASE WHEN o_custkey % 2 = 0 THEN -18000 ELSE 28800 END AS off, o_custkey FROM orders) WHERE k % 6 <> 0 AND o_custkey % 41 <> 0 GROUP BY 1, 2""")


@Q.add("a08_chart_parse", "bars", "SELECT ticker, CAST(date AS VARCHAR) AS date, close FROM bars")
def _(t):
    return P.parse_charts(t.charts).withColumn("date", F.col("date").cast("string"))


@Q.add("a09_latest_quotes", "bars", """SELECT ticker, max(close) FILTER (rn = 1) AS price, max(close) FILTER (rn = 2) AS prev_close,
  round((max(close) FILTER (rn = 1) - max(close) FILTER (rn = 2)) / nullif(max(close) FILTER (rn = 2), 0) * 100, 2) AS change_pct, CAST(max(date) AS VARCHAR) AS market_date
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM bars) WHERE rn <= 2 GROUP BY 1""")
def _(t):
    return P.latest_quotes(P.parse_charts(t.charts), 1).drop("quoted_at_ms").withColumn("market_date", F.col("market_date").cast("string"))


@Q.add("a09_store_closes", "px bars", "SELECT ticker, CAST(date AS VARCHAR) AS date, close FROM px WHERE ticker <> 'U0' UNION ALL SELECT ticker, CAST(date AS VARCHAR), close + CASE WHEN ticker = 'U0' THEN 1 ELSE 0 END FROM px WHERE ticker = 'U0' UNION ALL SELECT ticker, CAST(date AS VARCHAR), close FROM bars")
def _(t):
    new = t.prices.filter("ticker = 'U0'").withColumn("close", F.col("close") + 1).unionByName(P.parse_charts(t.charts))
    return P.store_closes(t.prices, new).withColumn("date", F.col("date").cast("string"))


@Q.add("w06_previous_close", "px", "SELECT ticker, CAST(date AS VARCHAR) AS date, close, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev_close FROM px")
def _(t):
    return P.with_previous(t.prices).withColumn("date", F.col("date").cast("string"))


@Q.add("c19_need_refresh", "", "SELECT true AS need_refresh, count(*) FILTER (c_custkey % 3 = 0) AS missing, count(*) FILTER (c_custkey % 3 <> 0 AND 5000 - c_custkey > 4000) AS stale FROM customer")
def _(t):
    c = t.raw("customer").select(F.col("c_name").alias("ticker"), F.col("c_custkey").alias("quoted_at_ms"))
    return P.need_refresh(c, c.filter("quoted_at_ms % 3 <> 0"), 5000, 4000)
