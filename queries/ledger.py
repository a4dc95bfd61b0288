"""Run ledger."""

from pyspark.sql import functions as F

from crowdgauge.operators import ledger as L

from .base import Registry

Q = Registry()


@Q.add("g15_trailing_budget", "ledger", """SELECT id, CAST(sum(requests_est) OVER (ORDER BY started_at_ms RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW) AS BIGINT) AS used_24h,
  sum(requests_est) OVER (ORDER BY started_at_ms RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW) + 500 > 17000 AS exhausted FROM ledger""")
def _(t):
    return L.trailing_budget(t.runs, 17000, 500).select("id", "used_24h", "exhausted")


@Q.add("w10_trailing_hour", "ledger", "SELECT id, CAST(sum(requests_est) OVER (ORDER BY started_at_ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM ledger")
def _(t):
    return L.trailing_budget(t.runs, 0, 0, span_ms=3_600_000).select("id", F.col("used_24h").alias("used"))


@Q.add("g15_budget_state", "ledger", "SELECT CAST(coalesce(sum(requests_est), 0) AS BIGINT) AS used_24h, 500 AS estimated_next_cycle, coalesce(sum(requests_est), 0) + 500 > 17000 AS exhausted FROM ledger WHERE started_at_ms >= 1706486400000")
def _(t):
    return L.budget_state(t.runs, 1706486400000 + 86_400_000, 17000, 500)


@Q.add("g16_cycle_estimate", "", "SELECT count(DISTINCT source) * 20 * (1 + 10) AS estimate FROM documents")
def _(t):
    return L.cycle_estimate(t.raw("documents").select("source").distinct(), 20, 10)


@Q.add("w11_risk_cooldown", "ledger", "SELECT CASE WHEN contains(coalesce(error, ''), 'CAPTCHA') THEN finished_at_ms + 86400000 END AS cooldown_until_ms FROM ledger WHERE finished_at_ms IS NOT NULL ORDER BY id DESC LIMIT 1")
def _(t):
    return L.risk_cooldown(t.runs)


@Q.add("c18_admission", "ledger", """
  WITH r AS (SELECT *, last_value(CASE WHEN error = 'login_required' THEN coalesce(finished_at_ms, started_at_ms) END IGNORE NULLS) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base,
      lag(started_at_ms) OVER (ORDER BY id) AS prev,
      sum(requests_est) OVER (ORDER BY started_at_ms RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW) - requests_est AS used FROM ledger),
  d AS (SELECT *, base IS NOT NULL AND base > 0 AND base + 600000 > started_at_ms AS cooling, prev IS NOT NULL AND prev + 120000 > started_at_ms AS waiting FROM r)
  SELECT id, CASE WHEN cooling THEN 'auth_cooldown' WHEN waiting THEN 'min_gap' WHEN used + 500 > 17000 THEN 'daily_budget' ELSE 'allowed' END AS reason,
    CASE WHEN cooling THEN base + 600000 WHEN waiting THEN prev + 120000 END AS until_ms, CASE WHEN cooling THEN base + 600000 WHEN waiting THEN prev + 120000 END - started_at_ms AS retry_after_ms,
    NOT cooling AS force_allowed FROM d""")
def _(t):
    return L.admission(t.runs, limit=17000, estimate=500, cooldown_ms=600_000, gap_ms=120_000)


@Q.add("x05_run_outcome", "", """SELECT event_id, CASE WHEN c THEN b WHEN l THEN 'failed' WHEN w THEN b WHEN f > 0 THEN b WHEN m > 0 THEN 'partial' ELSE 'success' END AS status,
  CASE WHEN c THEN 'cancelled' WHEN l THEN 'login_required' WHEN w THEN 'walled' WHEN f > 0 THEN 'failures' WHEN m > 0 THEN 'malformed' END AS error_kind
  FROM (SELECT event_id, event_type = 'signup' AND user_id % 2 = 0 AS c, event_type = 'error' AS l, event_type = 'click' AND user_id % 3 = 0 AS w, user_id % 5 AS f, user_id % 4 AS m,
    CASE WHEN user_id % 7 > 0 THEN 'partial' ELSE 'failed' END AS b FROM events)""")
def _(t):
    u, k = F.col("user_id"), F.col("event_type")
    r = t.raw("events").select("event_id", ((k == "signup") & (u % 2 == 0)).alias("cancelled"), (k == "error").alias("login_needed"),
                               ((k == "click") & (u % 3 == 0)).alias("walled"), (u % 5).alias("failures"), (u % 4).alias("malformed"), (u % 7).alias("notes_fresh"))
    return L.outcome(r).select("event_id", "status", "error_kind")


@Q.add("x04_session_state", "ledger", """SELECT CASE WHEN live IN ('unauthorized', 'expired') THEN live WHEN log_class = 'unauthorized' THEN 'unauthorized' WHEN coalesce(error, '') = 'login_required' OR log_class = 'expired' THEN 'expired'
  WHEN notes_fresh > 0 THEN 'valid' ELSE 'unknown' END AS state FROM (SELECT *, (SELECT arg_max(log_class, id) FROM ledger WHERE status = 'running') AS live FROM ledger WHERE status <> 'running' ORDER BY id DESC LIMIT 1)""")
def _(t):
    return L.session_state(t.runs)
