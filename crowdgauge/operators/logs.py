"""Run-log analytics over a table of log lines (run_id, lineno, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K

# Input patterns of the run logs.
ERROR_LINE = r"^.* ERROR \([^)]+\) - (.*)$"
EXCEPTION_LINE = r"^[A-Za-z_][\w.]*(?:Error|Exception|Interrupt)\b.*$"
KEYWORD_LINE = r"Current search keyword: (.+)"
STAMP_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) .*Current search keyword: (.+)$"
MAX_LINE = 200


def _has(marker: str) -> Column:
    return F.contains("line", F.lit(marker))


def _any(markers) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | _has(m)
    return out


def marker_count(lines: DataFrame, marker: str = K.CAPTCHA_MARKER) -> DataFrame:
    """Occurrences of a marker per run."""
    n = (F.length("line") - F.length(F.replace("line", F.lit(marker), F.lit("")))) / len(marker)
    return lines.groupBy("run_id").agg(F.sum(n.cast("bigint")).alias("captchas"))


def extracted(lines: DataFrame, max_line: int = MAX_LINE, *more: Column) -> DataFrame:
    """Lines with the keyword, start time, error and exception they carry, messages cut at ``max_line``."""
    error = F.regexp_extract("line", ERROR_LINE, 1)
    is_exc = F.col("line").rlike(EXCEPTION_LINE)
    keyword = F.trim(F.regexp_extract("line", KEYWORD_LINE, 1))
    stamp = F.regexp_extract("line", STAMP_LINE, 1)
    return lines.select(
        "run_id", "lineno", F.when(keyword != "", keyword).alias("keyword"),
        F.when(stamp != "", stamp).alias("started_at"),
        F.when(F.col("line").rlike(ERROR_LINE), F.substring(F.rtrim(error), 1, max_line)).alias("error"),
        F.when(is_exc, F.substring(F.rtrim("line"), 1, max_line)).alias("exception"), *more)


def failure_cause(lines: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, cause, captchas) by precedence: CAPTCHA, verification crash, network, retries,
    exit code. ``runs`` has run_id and exit_code; runs without lines are kept."""
    captcha = (F.length("line") - F.length(F.replace("line", F.lit(K.CAPTCHA_MARKER), F.lit("")))) / len(K.CAPTCHA_MARKER)
    flags = lines.groupBy("run_id").agg(
        F.sum(captcha.cast("bigint")).alias("captchas"), F.bool_or(_has(K.VERIFY_MARKER)).alias("verify"),
        F.min(F.coalesce(*[F.when(_has(m), F.lit(i)) for i, m in enumerate(K.NETWORK_MARKERS)])).alias("net"),
        F.bool_or(_has(K.RETRY_MARKER)).alias("retry"))
    names = F.array(*[F.lit(m) for m in K.NETWORK_MARKERS])
    cause = (
        F.when(F.col("captchas") > 0, F.concat(F.lit("captcha:"), F.col("captchas").cast("string")))
        .when(F.col("verify"), "captcha_detector_crash")
        .when(F.col("net").isNotNull(), F.concat(F.lit("network:"), F.element_at(names, F.col("net") + 1)))
        .when(F.col("retry"), "retries_exhausted")
        .otherwise(F.concat(F.lit("exit:"), F.col("exit_code").cast("string"))))
    return runs.select("run_id", "exit_code").join(flags, "run_id", "left").select(
        "run_id", cause.alias("cause"), F.coalesce("captchas", F.lit(0)).alias("captchas"))


def _last_marker(markers: tuple) -> Column:
    """Phase of a single line: the marker that starts furthest right in it."""
    spots = F.array(*[
        F.struct((F.length("line") - F.instr(F.reverse("line"), F.lit(m[::-1])) - len(m) + 2).alias("at"),
                 F.lit(-i).alias("pri"), F.lit(name).alias("phase"))
        for i, (m, name) in enumerate(markers)])
    held = F.filter(spots, lambda s: F.element_at(F.array(*[_has(m) for m, _ in markers]), 1 - s["pri"]))
    return F.array_max(held)["phase"]


def progress(lines: DataFrame, planned: DataFrame | None = None, yields: DataFrame | None = None,
             max_line: int = MAX_LINE) -> DataFrame:
    """Where each run has got to: current keyword, phase, notes in the comment phase since the
    last keyword, CAPTCHAs, last error.

    With ``planned`` (run_id, pos, keyword) also which of the planned keywords this is, from 1, and how many there are; with
    ``yields`` (run_id, keyword, notes, comments) what has landed for it and for the run."""
    e = lines.withColumns({
        "phase": _last_marker(K.PHASE_MARKERS), "hint": _any(K.LOGIN_HINTS),
        "kw_line": _has(K.KEYWORD_MARKER), "in_comments": _has(K.COMMENT_PHASE_MARKER)})
    e = e.withColumns({"keyword": F.when(F.trim(F.regexp_extract("line", KEYWORD_LINE, 1)) != "",
                                         F.trim(F.regexp_extract("line", KEYWORD_LINE, 1))),
                       "error": F.when(F.col("line").rlike(ERROR_LINE), F.substring(
                           F.rtrim(F.regexp_extract("line", ERROR_LINE, 1)), 1, max_line))})
    captcha = (F.length("line") - F.length(F.replace("line", F.lit(K.CAPTCHA_MARKER), F.lit("")))) / len(K.CAPTCHA_MARKER)

    def last(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("lineno")))

    run = e.groupBy("run_id").agg(
        last("keyword").alias("keyword"), last("phase").alias("last_phase"), F.bool_or("hint").alias("hint"),
        F.max(F.when(F.col("kw_line"), F.col("lineno"))).alias("kw_at"),
        F.sum(captcha.cast("bigint")).alias("captchas"), last("error").alias("last_error"))
    done = e.filter("in_comments").select("run_id", "lineno").join(
        run.select("run_id", "kw_at"), "run_id").filter(F.col("lineno") >= F.col("kw_at")).groupBy(
        "run_id").agg(F.count(F.lit(1)).alias("done"))
    phase = F.coalesce("last_phase", F.when(F.col("hint"), "login").otherwise("starting"))
    out = run.join(done, "run_id", "left").select(
        "run_id", "keyword", phase.alias("phase"), "captchas", "last_error",
        F.coalesce("done", F.lit(0)).alias("kw_comment_notes_done"))
    if planned is not None:
        place = planned.select("run_id", "keyword", (F.col("pos") + 1).alias("keyword_index"))
        total = planned.groupBy("run_id").agg(F.count(F.lit(1)).alias("keyword_total"))
        out = out.join(place, ["run_id", "keyword"], "left").join(total, "run_id", "left").fillna(0, ["keyword_total"])
    if yields is not None:
        of_run = yields.groupBy("run_id").agg(F.sum("notes").alias("notes"), F.sum("comments").alias("comments"))
        of_keyword = yields.select("run_id", "keyword", F.col("notes").alias("kw_notes"), F.col("comments").alias("kw_comments"))
        out = out.join(of_keyword, ["run_id", "keyword"], "left").join(of_run, "run_id", "left").fillna(
            0, ["kw_notes", "kw_comments", "notes", "comments"])
    return out


def last_distinct(values: DataFrame, column: str, n: int, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """(*by, value, at): the last n distinct values of each run, or other group, by last occurrence."""
    seen = values.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("value")).agg(
        F.max("lineno").alias("at"))
    order = Window.partitionBy(*by).orderBy(F.desc("at"))
    return seen.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n).drop("_rn")


def under_keywords(extracts: DataFrame, split: int = 10_000) -> DataFrame:
    """``extracted`` lines with ``under``: the last keyword with a start time at or before the line, null before the first one.

    Two levels, so that the lines of one long log spread over tasks: of each split of ``split`` lines the last keyword is
    kept, only these are ordered along the run and carried to the next split that needs them, and lines are ordered
    within their split alone."""
    here = F.when(F.col("started_at").isNotNull(), F.col("keyword"))
    rows = extracts.withColumns({"_split": F.floor(F.col("lineno") / split), "_here": here})
    before = Window.partitionBy("run_id").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("run_id", "_split").agg(
        F.max_by("_here", F.when(F.col("_here").isNotNull(), F.col("lineno"))).alias("_last")).select(
        "run_id", "_split", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    within = Window.partitionBy("run_id", "_split").orderBy("lineno").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(carried, ["run_id", "_split"]).withColumn("under", F.coalesce(
        F.last("_here", ignorenulls=True).over(within), F.col("_carried"))).drop("_split", "_here", "_carried")


def keyword_states(lines: DataFrame, planned: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, keyword, started_at, state) for planned and reached keywords.

    ``planned`` has (run_id, pos, keyword), ``runs`` (run_id, status). The last reached keyword,
    in planned order then order of appearance, is where an unfinished run stands or died.
    """
    x = extracted(lines).filter(F.col("started_at").isNotNull()).groupBy("run_id", "keyword").agg(
        F.min_by("started_at", "lineno").alias("started_at"), F.min("lineno").alias("first_line"))
    spine = planned.join(x, ["run_id", "keyword"], "full_outer").join(runs.select("run_id", "status"), "run_id")
    order = F.struct(F.col("pos").isNull().cast("int"), F.coalesce("pos", "first_line"))
    lastk = spine.filter(F.col("started_at").isNotNull()).groupBy("run_id").agg(
        F.max_by("keyword", order).alias("last_keyword"))
    state = (
        F.when(F.col("started_at").isNull(), "not_reached")
        .when((F.col("keyword") != F.col("last_keyword")) | (F.col("status") == "success"), "done")
        .when(F.col("status") == "running", "current").otherwise("died_here"))
    return spine.join(lastk, "run_id", "left").select("run_id", "keyword", "started_at", state.alias("state"))


def anatomy(lines: DataFrame, planned: DataFrame, runs: DataFrame, yields: DataFrame, errors: int = 5, exceptions: int = 4,
            split: int = 10_000, max_line: int = MAX_LINE) -> DataFrame:
    """One row per run and keyword, planned or reached: place in the plan (from 1, null if unplanned), start, state, what landed for
    it (``yields``: run_id, keyword, notes, comments), and of the log lines under it the CAPTCHAs, the notes whose comments
    were asked for, and the last distinct errors and exceptions, oldest first. What a run says before its first
    keyword stands in a row without keyword."""
    marks = (F.length("line") - F.length(F.replace("line", F.lit(K.CAPTCHA_MARKER), F.lit("")))) / len(K.CAPTCHA_MARKER)
    told = under_keywords(extracted(lines, max_line, marks.cast("bigint").alias("captchas"),
                                    _has(K.COMMENT_PHASE_MARKER).cast("bigint").alias("in_comments")), split)
    key = ("run_id", "under")
    sums = told.groupBy(*key).agg(F.sum("captchas").alias("captchas"), F.sum("in_comments").alias("comment_notes"))

    def listed(column: str, n: int) -> DataFrame:
        return last_distinct(told, column, n, key).groupBy(*key).agg(F.transform(
            F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias(f"{column}s"))

    states = keyword_states(lines, planned, runs).join(
        planned.select("run_id", "keyword", (F.col("pos") + 1).alias("keyword_index")), ["run_id", "keyword"], "left").join(
        yields.select("run_id", "keyword", "notes", "comments"), ["run_id", "keyword"], "left")
    unnamed = sums.filter("under is null").join(runs.select("run_id"), "run_id", "left_semi").select("run_id")
    out = states.unionByName(unnamed, allowMissingColumns=True).withColumnRenamed("keyword", "under")
    for part in (sums, listed("error", errors), listed("exception", exceptions)):
        part = part.withColumnsRenamed({"run_id": "_run", "under": "_under"})
        out = out.join(part, (F.col("run_id") == F.col("_run")) & F.col("under").eqNullSafe(F.col("_under")), "left").drop("_run", "_under")
    none = F.array().cast("array<string>")
    return out.fillna(0, ["notes", "comments", "captchas", "comment_notes"]).select(
        "run_id", F.col("under").alias("keyword"), "keyword_index", "started_at", "state", "notes", "comments", "captchas", "comment_notes",
        F.coalesce("errors", none).alias("errors"), F.coalesce("exceptions", none).alias("exceptions"))


def classify(lines: DataFrame) -> DataFrame:
    """(run_id, log_class, expired, hint): unauthorized outranks expired outranks unknown."""
    flags = lines.groupBy("run_id").agg(
        F.bool_or(_any(K.UNAUTHORIZED_MARKERS)).alias("unauthorized"),
        F.bool_or(_any(K.EXPIRED_MARKERS)).alias("expired"), F.bool_or(_any(K.LOGIN_HINTS)).alias("hint"))
    kind = F.when(F.col("unauthorized"), "unauthorized").when(F.col("expired"), "expired").otherwise("unknown")
    return flags.select("run_id", kind.alias("log_class"), "expired", "hint")


def login_required(lines: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, login_required): expired marker, or nothing fresh and a login hint."""
    c = classify(lines)
    return runs.select("run_id", "notes_fresh").join(c, "run_id", "left").select("run_id", F.coalesce(
        F.col("expired") | ((F.col("notes_fresh") <= 0) & F.col("hint")), F.lit(False)).alias("login_required"))
