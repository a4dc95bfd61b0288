"""Run ledger: trailing budgets, cooldowns, admission, outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import values as V
from ..session import checkpointed


def cycle_estimate(keywords: DataFrame, notes_per_keyword: int, comments_per_note: int) -> DataFrame:
    """Worst-case requests of one cycle: one row."""
    return keywords.agg((F.count(F.lit(1)) * notes_per_keyword * (1 + comments_per_note)).alias("estimate"))


def trailing_budget(runs: DataFrame, limit: int, estimate: int, span_ms: int = K.DAY_MS,
                    bucket_ms: int = K.HOUR_MS) -> DataFrame:
    """Every run with the requests of the trailing span up to and including it.

    Each run adds its requests at its start and takes them back after the span; a running total
    over these changes is the trailing sum. Changes are first folded per millisecond, so an hour bucket holds at most as
    many rows as it has milliseconds, however many runs it has; across buckets only their sums are ordered. Runs look
    their total up by an equi-join.
    """
    gain = runs.select(F.col("started_at_ms").alias("t"), F.col("requests_est").alias("v"))
    loss = runs.select((F.col("started_at_ms") + span_ms + 1).alias("t"), (-F.col("requests_est")).alias("v"))
    changes = gain.unionByName(loss).groupBy("t").agg(F.sum("v").alias("v")).withColumn("b", F.floor(F.col("t") / bucket_ms))
    inside = Window.partitionBy("b").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    sums = changes.groupBy("b").agg(F.sum("v").alias("s"))
    before = Window.partitionBy(F.lit(1)).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("b", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("carry"))
    used = changes.withColumn("run_sum", F.sum("v").over(inside)).join(carried, "b").select(
        F.col("t").alias("started_at_ms"), (F.col("run_sum") + F.col("carry")).alias("used_24h"))
    return runs.select("id", "started_at_ms", "requests_est").join(used, "started_at_ms").select(
        "id", "started_at_ms", "requests_est", "used_24h", (F.col("used_24h") + estimate > limit).alias("exhausted"))


def budget_state(runs: DataFrame, now_ms: int, limit: int, estimate: int) -> DataFrame:
    """One row: requests of the last 24 hours and whether one more cycle fits."""
    used = F.coalesce(F.sum(F.when(F.col("started_at_ms") >= now_ms - K.DAY_MS, F.col("requests_est"))), F.lit(0))
    return runs.agg(used.alias("used_24h"), F.lit(estimate).alias("estimated_next_cycle"),
                    (used + estimate > limit).alias("exhausted"))


def risk_cooldown(runs: DataFrame, cooldown_ms: int = K.DAY_MS) -> DataFrame:
    """One row: when scheduled cycles may resume. Only the newest finished run counts, and only
    if its error names a CAPTCHA."""
    newest = F.max_by(F.struct("finished_at_ms", "error"), F.when(F.col("finished_at_ms").isNotNull(), F.col("id")))
    return runs.agg(newest.alias("r")).select(F.when(
        F.contains(F.coalesce("r.error", F.lit("")), F.lit("CAPTCHA")),
        F.col("r.finished_at_ms") + cooldown_ms).alias("cooldown_until_ms"))


def admission(runs: DataFrame, *, limit: int, estimate: int, cooldown_ms: int, gap_ms: int,
              verified_at_ms: int = 0, bucket_ms: int = K.DAY_MS) -> DataFrame:
    """What the gate would have answered at each run's start, from the runs before it.

    Precedence: login cooldown (never forceable), minimum gap, daily budget. Columns: id, reason,
    until_ms, retry_after_ms, force_allowed. Rows are dealt by ranges of their ids, however these are spaced, and scanned
    within a range; one row a range carries the last start and flag on.
    """
    base = F.coalesce("finished_at_ms", "started_at_ms")
    flagged = F.when(F.col("error") == "login_required", F.struct(F.col("id").alias("flag_id"), base.alias("base")))
    rows = checkpointed(runs.withColumn("_flag", flagged).repartitionByRange("id").withColumn("_b", F.spark_partition_id()))
    inside = Window.partitionBy("_b").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({
        "_f": F.last("_flag", ignorenulls=True).over(inside),
        "_p": F.last("started_at_ms").over(inside)})
    tail = rows.groupBy("_b").agg(
        F.max_by("_flag", F.when(F.col("_flag").isNotNull(), F.col("id"))).alias("lf"),
        F.max_by("started_at_ms", "id").alias("lp"))
    across = Window.partitionBy(F.lit(1)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = tail.select("_b", F.last("lf", ignorenulls=True).over(across).alias("cf"),
                        F.last("lp", ignorenulls=True).over(across).alias("cp"))
    used = trailing_budget(runs, limit, estimate).select(
        "id", (F.col("used_24h") - F.col("requests_est")).alias("used_before"))
    seen = local.join(carry, "_b", "left").join(used, "id").select(
        "id", "started_at_ms", F.coalesce("_f", "cf")["base"].alias("base"),
        F.coalesce("_p", "cp").alias("prev_start"), "used_before")
    now = F.col("started_at_ms")
    cool = F.col("base") + cooldown_ms
    cooling = F.col("base").isNotNull() & (F.lit(verified_at_ms) < F.col("base")) & (cool > now)
    gap = F.col("prev_start") + gap_ms
    waiting = F.col("prev_start").isNotNull() & (gap > now)
    reason = F.when(cooling, "auth_cooldown").when(waiting, "min_gap").when(
        F.col("used_before") + estimate > limit, "daily_budget")
    until = F.when(cooling, cool).when(waiting, gap)
    return seen.select("id", F.coalesce(reason, F.lit("allowed")).alias("reason"), until.alias("until_ms"),
                       (until - now).alias("retry_after_ms"), (~cooling).alias("force_allowed"))


def outcome(runs: DataFrame) -> DataFrame:
    """Adds status and error_kind from cancelled, login_needed, walled, failures, malformed,
    notes_fresh; the first that holds decides."""
    banked = F.when(F.col("notes_fresh") > 0, "partial").otherwise("failed")
    kinds = [("cancelled", F.col("cancelled"), banked), ("login_required", F.col("login_needed"), F.lit("failed")),
             ("walled", F.col("walled"), banked), ("failures", F.col("failures") > 0, banked),
             ("malformed", F.col("malformed") > 0, F.lit("partial"))]
    status, kind = F.lit("success"), F.lit(None).cast("string")
    for name, when, result in reversed(kinds):
        status = F.when(when, result).otherwise(status)
        kind = F.when(when, F.lit(name)).otherwise(kind)
    return runs.withColumns({"status": status, "error_kind": kind})


def session_state(runs: DataFrame, verified_at_ms: int = 0) -> DataFrame:
    """One row (state): health of the account session from run flags.

    ``runs`` needs id, status, error, notes_fresh, started/finished_at_ms and log_class
    (unauthorized, expired, unknown). The newest finished run decides; a login verified after it
    overrides; a running run can only make it worse.
    """
    cols = F.struct("error", "notes_fresh", "log_class", F.coalesce("finished_at_ms", "started_at_ms").alias("end"))
    running = F.col("status") == "running"
    both = runs.agg(F.max_by(cols, F.when(~running, F.col("id"))).alias("last"),
                    F.max_by("log_class", F.when(running, F.col("id"))).alias("live"))
    verdict = (
        F.when(F.col("last.log_class") == "unauthorized", "unauthorized")
        .when((F.coalesce("last.error", F.lit("")) == "login_required") | (F.col("last.log_class") == "expired"), "expired")
        .when(F.col("last.notes_fresh") > 0, "valid").otherwise("unknown"))
    if verified_at_ms:
        verdict = F.when(F.lit(verified_at_ms) >= F.coalesce("last.end", F.lit(0)), "valid").otherwise(verdict)
    return both.select(F.when(F.col("live").isin("unauthorized", "expired"), F.col("live")).otherwise(verdict).alias("state"))


def usage_by_model(analyses: DataFrame) -> DataFrame:
    """Tokens and cost per model and day."""
    return analyses.groupBy("model", V.utc_day("generated_at_ms").alias("day")).agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.round(F.sum(V.token_cost("input_tokens", "output_tokens")), 6).alias("cost_usd"))

