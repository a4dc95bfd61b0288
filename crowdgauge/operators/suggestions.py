"""Slang mining: unmatched notes, vetting of suggested terms, corpus search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from .dictionary import Dictionary, known_terms
from .matching import has_context
from .tables import insert_absent

# Defaults of arguments: top-k reports and shown excerpts. Tests for words always see whole texts.
PREFILTER = 200
CANDIDATE_NOTES = 50
SHOWN_CHARS = 400
EVIDENCE_CHARS = 300


def unmatched_notes(notes: DataFrame, mentions: DataFrame, cutoff_ms: int) -> DataFrame:
    """Canonical window notes that name no entity."""
    return notes.filter((F.col("publish_time_ms") >= cutoff_ms) & F.col("dup_group_id").isNull()).join(
        mentions.filter("source_type = 'note'").select(F.col("source_id").alias("note_id")), "note_id", "left_anti")


def candidates(notes: DataFrame, mentions: DataFrame, dictionary: Dictionary, cutoff_ms: int,
               limit: int = CANDIDATE_NOTES, prefilter: int = PREFILTER) -> DataFrame:
    """(item, note_id, likes, text): of the ``prefilter`` most liked unmatched notes, the first ``limit``
    that hold a context word, with their whole texts."""
    order = [F.desc("likes"), F.asc("note_id")]
    top = unmatched_notes(notes, mentions, cutoff_ms).select(
        "note_id", F.coalesce("liked_count", F.lit(0)).alias("likes"),
        F.trim(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("note_desc", F.lit("")))).alias("text"),
    ).orderBy(*order).limit(prefilter)
    fit = has_context(top.filter("text <> ''"), dictionary, ["note_id"])
    kept = top.join(fit, "note_id", "left_semi").orderBy(*order).limit(limit)
    return kept.select(
        F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).alias("item"), "note_id", "likes", "text")


def vet(suggested: DataFrame, pool: DataFrame, dictionary: Dictionary, now_ms: int,
        chars: int = EVIDENCE_CHARS) -> DataFrame:
    """Suggested (item, term, ticker, evidence) that hold up against the candidate notes.

    The ticker must be valid, the term unknown and found verbatim in a note: the cited one, else
    the first. Whole texts are searched; only the quote is cut, to ``chars``. Evidence that is not verbatim is
    replaced by the note's text. The pool has at most as many rows as ``candidates`` was asked for and is offered to each suggestion as one array.
    """
    listed = pool.agg(F.array_sort(F.collect_list(F.struct(
        "item", "note_id", "text", T.norm_for_hash("text").alias("norm")))).alias("p")).scalar()
    term, ticker = F.trim("term"), F.upper(F.trim("ticker"))
    rows = suggested.select(
        F.coalesce("item", F.lit(0)).alias("item"), term.alias("term"), ticker.alias("ticker"),
        F.trim(F.coalesce("evidence", F.lit(""))).alias("evidence"), T.norm_for_hash(term).alias("needle"))
    rows = rows.filter((F.col("term") != "") & V.valid_ticker("ticker") & (F.upper("term") != F.col("ticker")) & (F.col("needle") != ""))
    rows = rows.join(known_terms(dictionary.stocks).withColumnRenamed("term", "_known"),
                     F.lower("term") == F.col("_known"), "left_anti").withColumn("_pool", listed)
    holds = F.filter("_pool", lambda n: F.contains(n["norm"], F.col("needle")))
    cited = F.filter(holds, lambda n: n["item"] == F.col("item"))
    found = rows.withColumn("n", F.coalesce(F.get(cited, F.lit(0)), F.get(holds, F.lit(0)))).filter(F.col("n").isNotNull())
    proof = T.norm_for_hash("evidence")
    quote = F.when((F.col("evidence") != "") & F.contains("n.norm", proof), F.col("evidence")).otherwise(F.col("n.text"))
    return found.select(
        "term", F.col("ticker").alias("guessed_ticker"), F.substring(quote, 1, chars).alias("evidence_quote"),
        F.col("n.note_id").alias("evidence_note_id"), F.lit(now_ms).alias("suggested_at_ms"))


def suggest(existing: DataFrame, proposals: DataFrame, now_ms: int) -> DataFrame:
    """Proposals (term, ticker, evidence_quote) with status ok or already_suggested."""
    p = proposals.select(
        F.trim("term").alias("term"), F.upper(F.trim("ticker")).alias("guessed_ticker"),
        F.substring(F.trim(F.coalesce("evidence_quote", F.lit(""))), 1, EVIDENCE_CHARS).alias("evidence_quote"),
        F.lit(now_ms).alias("suggested_at_ms"))
    new = insert_absent(existing, p, ["term", "guessed_ticker"], F.struct("evidence_quote")).withColumn("status", F.lit("ok"))
    seen = p.join(existing.select("term", "guessed_ticker"), ["term", "guessed_ticker"], "left_semi").select(
        *p.columns).distinct().withColumn("status", F.lit("already_suggested"))
    return new.unionByName(seen)


def search(notes: DataFrame, comments: DataFrame, query: str, limit: int = 20) -> dict[str, DataFrame]:
    """Substring search: uncapped hit counts, and the most liked hits of each table."""
    n = notes.filter(T.search_match("title", query) | T.search_match("note_desc", query))
    c = comments.filter(T.search_match("content", query))
    hits = n.select(F.lit("n").alias("k")).union(c.select(F.lit("c"))).agg(
        F.count_if(F.col("k") == "n").alias("note_hits"), F.count_if(F.col("k") == "c").alias("comment_hits"))
    joined = F.trim(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("note_desc", F.lit(""))))
    top_notes = n.select(F.col("note_id").alias("id"), F.col("liked_count").alias("likes"),
                         F.substring(joined, 1, 300).alias("text")).orderBy(F.desc("likes"), "id").limit(limit)
    top_comments = c.select(F.col("comment_id").alias("id"), F.col("like_count").alias("likes"),
                            F.substring(F.coalesce("content", F.lit("")), 1, 200).alias("text")).orderBy(
        F.desc("likes"), "id").limit(limit)
    return {"hits": hits, "notes": top_notes, "comments": top_comments}
