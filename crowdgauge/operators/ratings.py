"""Ratings: validation, storage rows, currency, intake, and the pluggable rater."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .. import schemas as S
from ..functions.values import token_cost
from .evidence import fingerprints, pick_quotes, previous_summaries
from .quotes import quotes_from_ids
from .tables import latest

REPLY = S.RATING_REPLY
EMPTY = "array<string>"


def parse_reply(c) -> Column:
    """A rater's JSON reply as a struct with defaults; NULL when invalid (no summary)."""
    r = F.from_json(F.col(c) if isinstance(c, str) else c, REPLY)
    s = r["sentiment_counts"]
    return F.when(r["summary"].isNotNull(), F.struct(
        r["summary"].alias("summary"),
        F.coalesce(s["bullish"], F.lit(0)).alias("bullish"),
        F.coalesce(s["bearish"], F.lit(0)).alias("bearish"),
        F.coalesce(s["neutral"], F.lit(0)).alias("neutral"),
        F.coalesce(r["bull_points"], F.array().cast(EMPTY)).alias("bull_points"),
        F.coalesce(r["bear_points"], F.array().cast(EMPTY)).alias("bear_points"),
        F.coalesce(r["notable_quote_ids"], F.array().cast("array<int>")).alias("notable_quote_ids"),
        F.coalesce(r["irrelevant_item_count"], F.lit(0)).alias("irrelevant_item_count"),
    ))


def batch_is_complete(replies: DataFrame, requested: DataFrame) -> DataFrame:
    """(batch_id, complete): a batch reply must name exactly the requested entities, once each."""
    got = replies.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(F.upper("ticker"))).alias("got"))
    want = requested.groupBy("batch_id").agg(F.array_sort(F.collect_set("ticker")).alias("want"))
    return want.join(got, "batch_id", "left").select(
        "batch_id", F.coalesce(F.col("got") == F.col("want"), F.lit(False)).alias("complete"))


def prefixed_summary(ticker: Column, summary: Column) -> Column:
    s = F.trim(summary)
    return F.when(F.startswith(F.upper(s), F.concat(ticker, F.lit(":"))), s).otherwise(
        F.concat(ticker, F.lit(": "), s))


def analysis_rows(ratings: DataFrame, items: DataFrame, now_ms: int, window_ms: int,
                  scores: DataFrame | None = None, model: str = "rater",
                  run_id: int | None = None, usage: DataFrame | None = None) -> DataFrame:
    """Rows for the analysis table from validated ratings (ticker + parse_reply fields). ``usage`` has (ticker, input_tokens,
    output_tokens), say from ``allocate``; the cost follows from them."""
    base = ratings.withColumnRenamed("notable_quote_ids", "ids").withColumn("submission_id", F.col("ticker"))
    quotes = quotes_from_ids(base, items).select("ticker", "quotes")
    rows = base.drop("ids", "submission_id").join(fingerprints(items), "ticker").join(quotes, "ticker", "left")
    sentiment = F.to_json(F.struct("bullish", "bearish", "neutral"))
    rows = (rows.join(usage.select("ticker", "input_tokens", "output_tokens"), "ticker", "left") if usage is not None
            else rows.withColumns({c: F.lit(None).cast("bigint") for c in ("input_tokens", "output_tokens")}))
    return _scored(rows, scores).select(
        *_base(now_ms, window_ms, model, run_id),
        sentiment.alias("sentiment_counts"),
        prefixed_summary(F.col("ticker"), F.col("summary")).alias("summary"),
        F.to_json(F.slice("bull_points", 1, K.MAX_POINTS)).alias("bull_points"),
        F.to_json(F.slice("bear_points", 1, K.MAX_POINTS)).alias("bear_points"),
        F.to_json(F.coalesce("quotes", F.array().cast(EMPTY))).alias("notable_quotes"),
        "irrelevant_item_count", "input_tokens", "output_tokens",
        F.round(token_cost("input_tokens", "output_tokens"), 6).alias("cost_usd"),
        F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"),
    )


def _scored(rows: DataFrame, scores: DataFrame | None) -> DataFrame:
    return (rows.join(scores.select("ticker", "score"), "ticker", "left")
            if scores is not None else rows.withColumn("score", F.lit(0.0)))


def _base(now_ms: int, window_ms: int, model: str, run_id: int | None) -> list[Column]:
    """The columns every row of the analysis table has, over fingerprints with ``score``."""
    return [
        F.col("ticker"), F.lit(run_id).cast("bigint").alias("run_id"), F.lit(now_ms).alias("generated_at_ms"),
        F.lit(now_ms - window_ms).alias("window_start_ms"), F.lit(now_ms).alias("window_end_ms"),
        F.col("note_count"), (F.col("item_count") - F.col("note_count")).alias("comment_count"),
        F.coalesce("score", F.lit(0.0)).alias("popularity_score"),
        F.col("item_count").alias("input_item_count"), F.col("input_hash"), F.lit(model).alias("model")]


def error_rows(failures: DataFrame, items: DataFrame, now_ms: int, window_ms: int, scores: DataFrame | None = None,
               model: str = "rater", run_id: int | None = None) -> DataFrame:
    """Rows for the analysis table from failed requests (ticker, error): the evidence they were made on and no rating."""
    rows = failures.select("ticker", "error").join(fingerprints(items), "ticker")
    return _scored(rows, scores).select(*_base(now_ms, window_ms, model, run_id), F.lit("error").alias("status"), "error")


def is_current(evidence: DataFrame, analyses: DataFrame, statuses=("ok", "no_api_key")) -> DataFrame:
    """(ticker, input_hash, current): was the latest analysis made on exactly this evidence?"""
    last = latest(analyses.select("ticker", "generated_at_ms", "input_hash", "status"), ["ticker"],
                  F.struct("generated_at_ms", "input_hash")).select(
        "ticker", F.col("input_hash").alias("last_hash"), "status")
    same = (F.col("input_hash") == F.col("last_hash")) & F.col("status").isin(*statuses)
    return evidence.join(last, "ticker", "left").select(
        "ticker", "input_hash", F.coalesce(same, F.lit(False)).alias("current"))


def pending(candidates: DataFrame, evidence: DataFrame, analyses: DataFrame) -> DataFrame:
    """Candidates with evidence that no ok rating covers yet, in candidate order."""
    todo = is_current(evidence, analyses, statuses=("ok",)).filter(~F.col("current")).select("ticker")
    return candidates.join(evidence.select("ticker", F.col("item_count").alias("evidence_items")), "ticker").join(
        todo, "ticker", "left_semi").orderBy("section", "rank")


def intake(submissions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Submissions with ``outcome``: ok, stale_evidence (the evidence moved) or no_items."""
    cur = evidence.select("ticker", F.col("evidence_hash").alias("expected"))
    return submissions.join(cur, "ticker", "left").withColumn(
        "outcome", F.when(F.col("expected").isNull(), "no_items")
        .when(F.col("expected") == F.col("evidence_hash"), "ok").otherwise("stale_evidence"))


def staged(candidates: DataFrame, evidence: DataFrame, analyses: DataFrame, now_ms: int) -> DataFrame:
    """Per candidate: no_items, skipped_unchanged or prepared, with the previous summary."""
    cur = is_current(evidence, analyses).select("ticker", "current")
    state = F.when(F.col("current").isNull(), "no_items").when(
        F.col("current"), "skipped_unchanged").otherwise("prepared")
    return candidates.join(cur, "ticker", "left").withColumn("state", state).drop("current").join(
        previous_summaries(analyses, now_ms), "ticker", "left").withColumn(
        "prev_summary", F.when(F.col("state") == "prepared", F.col("prev_summary")))


def fallback_rows(items: DataFrame, analyses: DataFrame) -> DataFrame:
    """Quote-only rows for entities nothing has rated: an existing ok rating is never covered."""
    rated = analyses.filter("status = 'ok'").select("ticker")
    return pick_quotes(items.join(rated, "ticker", "left_anti")).groupBy("ticker").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("quote_no", "text"))),
                              lambda x: x["text"])).alias("notable_quotes"),
    ).withColumn("status", F.lit("no_api_key"))


def allocate(total: DataFrame, weights: DataFrame) -> DataFrame:
    """Largest-remainder split of each group's integer ``total`` by ``weight``; sums exactly.

    ``weights`` has (group_id, idx, weight); a group is one joint request of a few entities.
    """
    from pyspark.sql import Window

    sums = weights.groupBy("group_id").agg(F.sum("weight").alias("wsum"))
    rows = weights.join(sums, "group_id").join(total, "group_id")
    product = F.col("total") * F.col("weight")
    rows = rows.withColumns({"base": F.floor(product / F.col("wsum")), "rem": product % F.col("wsum")})
    rows = rows.withColumn("base", ((product - F.col("rem")) / F.col("wsum")).cast("bigint"))
    left = rows.groupBy("group_id").agg((F.first("total") - F.sum("base")).alias("leftover"))
    order = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("rem"), "idx"))
    return rows.withColumn("_r", order).join(left, "group_id").select(
        "group_id", "idx", "weight",
        (F.col("base") + (F.col("_r") <= F.col("leftover")).cast("bigint")).alias("allocated"))


def rate(items: DataFrame, rater: Callable[[pd.DataFrame], dict] | None = None) -> DataFrame:
    """Run a rater over each entity's evidence (at most the evidence cap of rows) and return one
    JSON reply per entity: (ticker, reply). The default counts words of a small lexicon."""
    fn = rater or lexicon_rater()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        import json

        import pandas

        reply = fn(group.sort_values("item_no"))
        return pandas.DataFrame({"ticker": [group["ticker"].iloc[0]], "reply": [json.dumps(reply)]})

    return items.select("ticker", "item_no", "type", "text", "likes").groupBy("ticker").applyInPandas(
        run, "ticker string, reply string")


def lexicon_rater(up=("buy", "up", "bull", "涨", "买"), down=("sell", "down", "bear", "跌", "卖")):
    """A deterministic sample rater."""

    def fn(group) -> dict:
        lean = []
        for text in group["text"]:
            low = text.lower()
            lean.append(sum(w in low for w in up) - sum(w in low for w in down))
        bull, bear = sum(x > 0 for x in lean), sum(x < 0 for x in lean)
        return {
            "summary": f"{bull} up, {bear} down of {len(lean)} items",
            "sentiment_counts": {"bullish": bull, "bearish": bear, "neutral": len(lean) - bull - bear},
            "notable_quote_ids": [int(n) for n in group["item_no"].head(3)],
        }

    return fn
