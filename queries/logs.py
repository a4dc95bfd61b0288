"""Run-log analytics."""


from pyspark.sql import functions as F

from crowdgauge.operators import keywords as KW
from crowdgauge.operators import logs as LG

from .base import Registry
from .sqlparts import part

Q = Registry()
part("logx", "log", r"""SELECT *, nullif(trim(regexp_extract(line, 'Current search keyword: (.+)', 1)), '') AS keyword,
  nullif(regexp_extract(line, '^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) .*Current search keyword: (.+)$', 1), '') AS started_at,
  CASE WHEN regexp_matches(line, '^.* ERROR \([^)]+\) - (.*)$') THEN substr(rtrim(regexp_extract(line, '^.* ERROR \([^)]+\) - (.*)$', 1)), 1, 200) END AS error,
  CASE WHEN regexp_matches(line, '^[A-Za-z_][\w.]*(?:Error|Exception|Interrupt)\b.*$') THEN substr(rtrim(line), 1, 200) END AS exception FROM log""")
CAP = "(length(line) - length(replace(line, 'CAPTCHA appeared', ''))) // 16"


@Q.add("f20_log_fields", "logx", "SELECT run_id, lineno, keyword, started_at, error, exception FROM logx")
def _(t):
    return LG.extracted(t.log_lines)


@Q.add("g22_marker_count", "log", f"SELECT run_id, CAST(sum({CAP}) AS BIGINT) AS captchas FROM log GROUP BY 1")
def _(t):
    return LG.marker_count(t.log_lines)


@Q.add("x01_failure_cause", "log log_runs", f"""SELECT r.run_id, CASE WHEN c > 0 THEN 'captcha:' || c WHEN net THEN 'network:ConnectTimeout' WHEN retry THEN 'retries_exhausted' ELSE 'exit:' || exit_code END AS cause, c AS captchas
  FROM log_runs r JOIN (SELECT run_id, CAST(sum({CAP}) AS BIGINT) AS c, bool_or(contains(line, 'ConnectTimeout')) AS net, bool_or(contains(line, 'RetryError')) AS retry FROM log GROUP BY 1) l ON l.run_id = r.run_id""")
def _(t):
    return LG.failure_cause(t.log_lines, t.log_runs)


PHASE = "CASE WHEN contains(line, 'Begin get note id comments') THEN 'comments' WHEN contains(line, 'Current search keyword') THEN 'search' END"


# What each run landed: two documents as notes of the run with half their number, turns as comments, some on notes of no run.
part("run_yields", "", """WITH n AS (SELECT doc_id // 2 AS run_id, doc_id AS note_id, 'k' || (doc_id % 5) AS keyword FROM documents),
  c AS (SELECT conv_id AS run_id, conv_id * 2 + turn % 3 AS note_id FROM conversations)
  SELECT n.run_id, n.keyword, count(DISTINCT n.note_id) AS notes, count(c.note_id) AS comments FROM n LEFT JOIN c ON c.run_id = n.run_id AND c.note_id = n.note_id GROUP BY 1, 2""")


def yields(t):
    d, c = t.raw("documents"), t.raw("conversations")
    notes = d.select(F.floor(F.col("doc_id") / 2).alias("run_id"), F.col("doc_id").cast("string").alias("note_id"),
                     F.concat(F.lit("k"), (F.col("doc_id") % 5).cast("string")).alias("source_keyword"), F.lit(0).alias("line_no"))
    comments = c.select(F.col("conv_id").alias("run_id"), (F.col("conv_id") * 2 + F.col("turn") % 3).cast("string").alias("note_id"))
    return KW.attribution(notes, comments, by=("run_id",))


@Q.add("x02_progress", "logx run_yields", f"""WITH a AS (SELECT run_id, arg_max(keyword, lineno) FILTER (keyword IS NOT NULL) AS keyword, arg_max({PHASE}, lineno) FILTER ({PHASE} IS NOT NULL) AS ph,
    bool_or(contains(line, 'login expired')) AS hint, max(lineno) FILTER (contains(line, 'Current search keyword')) AS kw_at, CAST(sum({CAP}) AS BIGINT) AS captchas,
    arg_max(error, lineno) FILTER (error IS NOT NULL) AS last_error FROM logx GROUP BY 1)
  SELECT a.run_id, keyword, coalesce(ph, CASE WHEN hint THEN 'login' ELSE 'starting' END) AS phase, captchas, last_error,
    (SELECT count(*) FROM log l WHERE l.run_id = a.run_id AND l.lineno >= a.kw_at AND contains(line, 'Begin get note id comments')) AS kw_comment_notes_done,
    CASE keyword WHEN 'k0' THEN 1 WHEN 'k3' THEN 2 WHEN 'k1' THEN 3 END AS keyword_index, CAST(3 AS BIGINT) AS keyword_total,
    coalesce((SELECT notes FROM run_yields y WHERE y.run_id = a.run_id AND y.keyword = a.keyword), 0) AS kw_notes,
    coalesce((SELECT comments FROM run_yields y WHERE y.run_id = a.run_id AND y.keyword = a.keyword), 0) AS kw_comments,
    CAST(coalesce((SELECT sum(notes) FROM run_yields y WHERE y.run_id = a.run_id), 0) AS BIGINT) AS notes,
    CAST(coalesce((SELECT sum(comments) FROM run_yields y WHERE y.run_id = a.run_id), 0) AS BIGINT) AS comments FROM a""")
def _(t):
    return LG.progress(t.log_lines, t.planned_keywords, yields(t))


@Q.add("x03_keyword_states", "logx log_runs", """
  WITH p AS (SELECT run_id, unnest(['k0', 'k3', 'k1']) AS keyword, unnest([0, 1, 2]) AS pos FROM log_runs),
  x AS (SELECT run_id, keyword, arg_min(started_at, lineno) AS started_at, min(lineno) AS l FROM logx WHERE started_at IS NOT NULL GROUP BY 1, 2),
  s AS (SELECT coalesce(p.run_id, x.run_id) AS run_id, coalesce(p.keyword, x.keyword) AS keyword, pos, started_at, l FROM p FULL JOIN x ON x.run_id = p.run_id AND x.keyword = p.keyword),
  z AS (SELECT run_id, arg_max(keyword, (pos IS NULL, coalesce(pos, l))) AS last FROM s WHERE started_at IS NOT NULL GROUP BY 1)
  SELECT s.run_id, s.keyword, s.started_at, CASE WHEN started_at IS NULL THEN 'not_reached' WHEN s.keyword <> z.last OR r.status = 'success' THEN 'done' WHEN r.status = 'running' THEN 'current' ELSE 'died_here' END AS state
  FROM s JOIN log_runs r ON r.run_id = s.run_id LEFT JOIN z ON z.run_id = s.run_id""")
def _(t):
    return LG.keyword_states(t.log_lines, t.planned_keywords, t.log_runs)


def last_listed(column, n):
    return f"""(SELECT run_id, under, string_agg(v, ' | ' ORDER BY at_line) AS {column}s FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, under ORDER BY at_line DESC) AS rn FROM (
      SELECT run_id, under, {column} AS v, max(lineno) AS at_line FROM u WHERE {column} IS NOT NULL GROUP BY 1, 2, 3)) WHERE rn <= {n} GROUP BY 1, 2)"""


@Q.add("x03_run_anatomy", "logx log_runs run_yields", f"""
  WITH u AS (SELECT *, last_value(CASE WHEN started_at IS NOT NULL THEN keyword END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY lineno ROWS UNBOUNDED PRECEDING) AS under FROM logx),
  p AS (SELECT run_id, unnest(['k0', 'k3', 'k1']) AS keyword, unnest([0, 1, 2]) AS pos FROM log_runs),
  x AS (SELECT run_id, keyword, arg_min(started_at, lineno) AS started_at, min(lineno) AS l FROM logx WHERE started_at IS NOT NULL GROUP BY 1, 2),
  s AS (SELECT coalesce(p.run_id, x.run_id) AS run_id, coalesce(p.keyword, x.keyword) AS keyword, pos, started_at, l FROM p FULL JOIN x ON x.run_id = p.run_id AND x.keyword = p.keyword),
  z AS (SELECT run_id, arg_max(keyword, (pos IS NULL, coalesce(pos, l))) AS last FROM s WHERE started_at IS NOT NULL GROUP BY 1),
  rows AS (SELECT s.run_id, s.keyword, CAST(pos + 1 AS INT) AS keyword_index, s.started_at, CASE WHEN started_at IS NULL THEN 'not_reached' WHEN s.keyword <> z.last OR r.status = 'success' THEN 'done'
      WHEN r.status = 'running' THEN 'current' ELSE 'died_here' END AS state FROM s JOIN log_runs r ON r.run_id = s.run_id LEFT JOIN z ON z.run_id = s.run_id
    UNION ALL SELECT DISTINCT run_id, NULL, NULL, NULL, NULL FROM u WHERE under IS NULL),
  sums AS (SELECT run_id, under, CAST(sum({CAP}) AS BIGINT) AS captchas, count(*) FILTER (contains(line, 'Begin get note id comments')) AS comment_notes FROM u GROUP BY 1, 2)
  SELECT rows.run_id, rows.keyword, keyword_index, started_at, state, coalesce(notes, 0) AS notes, coalesce(comments, 0) AS comments, coalesce(captchas, 0) AS captchas,
    coalesce(comment_notes, 0) AS comment_notes, coalesce(errors, '') AS errors, coalesce(exceptions, '') AS exceptions
  FROM rows LEFT JOIN run_yields y ON y.run_id = rows.run_id AND y.keyword = rows.keyword
    LEFT JOIN sums ON sums.run_id = rows.run_id AND sums.under IS NOT DISTINCT FROM rows.keyword
    LEFT JOIN {last_listed('error', 5)} e ON e.run_id = rows.run_id AND e.under IS NOT DISTINCT FROM rows.keyword
    LEFT JOIN {last_listed('exception', 4)} f ON f.run_id = rows.run_id AND f.under IS NOT DISTINCT FROM rows.keyword""")
def _(t):
    rows = LG.anatomy(t.log_lines, t.planned_keywords, t.log_runs, yields(t))
    return rows.withColumns({c: F.array_join(c, " | ") for c in ("errors", "exceptions")})


@Q.add("s11_last_distinct_errors", "logx", "SELECT run_id, value, at_line FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY at_line DESC) AS rn FROM (SELECT run_id, error AS value, max(lineno) AS at_line FROM logx WHERE error IS NOT NULL GROUP BY 1, 2)) WHERE rn <= 5")
def _(t):
    return LG.last_distinct(LG.extracted(t.log_lines), "error", 5).withColumnRenamed("at", "at_line")


@Q.add("x04_log_class", "log log_runs", """SELECT r.run_id, CASE WHEN e THEN 'expired' ELSE 'unknown' END AS log_class, e OR (notes_fresh <= 0 AND e) AS login_required
  FROM log_runs r JOIN (SELECT run_id, bool_or(contains(line, 'login expired')) AS e FROM log GROUP BY 1) l ON l.run_id = r.run_id""")
def _(t):
    lines = t.log_lines
    return LG.classify(lines).select("run_id", "log_class").join(LG.login_required(lines, t.log_runs), "run_id")
