"""Keyed-table operations: upsert with preserved columns, insert-if-absent, latest row, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import values as V


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], order: str,
           preserve: Sequence[str] = ()) -> DataFrame:
    """One row per key: the last writer wins by ``order``, columns in ``preserve`` keep the first
    writer's value. One shuffle with map-side combine."""
    rest = [c for c in old.columns if c not in key and c not in preserve]
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)),
                                                        allowMissingColumns=True)
    rank = F.struct("_new", order)
    aggs = [F.max_by(F.struct(*rest), rank).alias("last")]
    if preserve:
        aggs.append(F.min_by(F.struct(*preserve), rank).alias("first"))
    out = rows.groupBy(*key).agg(*aggs)
    return out.select(*[
        F.col(c) if c in key else F.col(f"first.{c}" if c in preserve else f"last.{c}").alias(c)
        for c in old.columns
    ])


def insert_absent(old: DataFrame, new: DataFrame, key: Sequence[str], order: Column | None = None) -> DataFrame:
    """The new rows whose key is not there yet, one per key, first by ``order``."""
    key = list(key)
    rest = [c for c in new.columns if c not in key]
    pick = F.min_by(F.struct(*rest), order if order is not None else F.struct(*rest)).alias("r")
    return new.groupBy(*key).agg(pick).select(
        *[F.col(c) if c in key else F.col(f"r.{c}") for c in new.columns]
    ).join(old.select(*key), key, "left_anti")


def latest(rows: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """The row with the greatest ``order`` of each key, by a grouped maximum instead of a sort."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")


def latest_usable(analyses: DataFrame, statuses=("ok", "no_api_key"), depth: int = 5) -> DataFrame:
    """Per ticker, among the newest ``depth`` rows: the newest usable one, else the newest."""
    newest = Window.partitionBy("ticker").orderBy(F.desc("generated_at_ms"), F.desc("run_id"))
    recent = analyses.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= depth)
    pick = F.struct((~F.col("status").isin(*statuses)).cast("int"), F.col("_rn"))
    rest = [c for c in analyses.columns if c != "ticker"]
    return recent.groupBy("ticker").agg(F.min_by(F.struct(*rest), pick).alias("r")).select("ticker", "r.*")


def apply_watch_list(tracked: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply a batch of add / delete requests (ticker, action, custom_keywords, requested_at_ms).

    Tickers are trimmed and upper-cased and must be 1–5 capitals; the last request of a ticker
    decides; re-adding keeps the first added_at_ms.
    """
    asked = changes.withColumn("ticker", F.upper(F.trim("ticker"))).filter(V.valid_ticker("ticker"))
    last = latest(asked, ["ticker"], F.struct("requested_at_ms", "action"))
    added = last.filter("action = 'add'").select(
        "ticker", F.col("requested_at_ms").alias("added_at_ms"),
        F.to_json(V.split_list("custom_keywords")).alias("custom_keywords"))
    kept = tracked.join(last.filter("action = 'delete'"), "ticker", "left_anti")
    return upsert(kept, added, ["ticker"], "added_at_ms", preserve=["added_at_ms"])


def rejected_changes(changes: DataFrame) -> DataFrame:
    return changes.withColumn("ticker", F.upper(F.trim("ticker"))).filter(~V.valid_ticker("ticker"))


def sweep(tables: dict[str, DataFrame], now_ms: int) -> dict[str, DataFrame]:
    """Retention: content 7 days, runs, analyses and snapshots 30 days; an old note stays while a
    remaining comment refers to it."""
    content = now_ms - K.RETAIN_CONTENT_DAYS * K.DAY_MS
    runs = now_ms - K.RETAIN_RUNS_DAYS * K.DAY_MS
    out = {}
    times = {"mentions": ("content_time_ms", content), "comments": ("create_time_ms", content),
             "analyses": ("generated_at_ms", runs), "snapshots": ("snapped_at_ms", runs),
             "runs": ("started_at_ms", runs)}
    for name, (column, cutoff) in times.items():
        if name in tables:
            out[name] = tables[name].filter(F.col(column) >= cutoff)
    if "notes" in tables:
        fresh = F.col("publish_time_ms") >= content
        notes = tables["notes"]
        old = notes.filter(~fresh).join(
            out["comments"].select("note_id").distinct(), "note_id", "left_semi")
        out["notes"] = notes.filter(fresh).unionByName(old.select(*notes.columns))
    return out


def without_comments(notes: DataFrame, comments: DataFrame) -> DataFrame:
    return notes.join(comments.select("note_id"), "note_id", "left_anti")


def sweep_prices(prices: DataFrame, today: Column | str) -> DataFrame:
    day = F.lit(today).cast("date") if isinstance(today, str) else today
    return prices.filter(F.col("date") >= F.date_sub(day, K.PRICE_KEEP_DAYS))


def enum_violations(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows whose value is outside the enumeration."""
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(*allowed))


def review_suggestions(suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply accept / reject decisions (id, action) to the suggestion table."""
    last = decisions.filter(F.col("action").isin("accept", "reject")).groupBy("id").agg(
        F.max_by("action", "decided_at_ms").alias("action"))
    status = F.when(F.col("action") == "accept", "accepted").when(F.col("action") == "reject", "rejected")
    return suggestions.join(last, "id", "left").withColumn(
        "status", F.coalesce(status, F.col("status"))).drop("action")


def listing(rows: DataFrame, status: str, limit: int | None = None) -> DataFrame:
    """Suggestions of a status, newest first."""
    out = rows.filter(F.col("status") == status).orderBy(F.desc("suggested_at_ms"), "id")
    return out.limit(limit) if limit else out


def recent_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(limit)
