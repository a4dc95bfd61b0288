"""Finding dictionary terms in text.

A text is never compared with every term. Each term has one key it cannot occur without (the
first whole word of a Latin term, the first two characters of any other), a text yields its
distinct keys, and an equi-join on the key produces the few candidates that are then verified
by the exact rule. The cost follows the text, not text × dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from .dictionary import Dictionary, inlined, match_terms_of, tracked_queries, trap_phrases
from .facts import with_facts

OTHER_CHAR = r"[^0-9a-z&.\- ]"
CAPITAL_WORD = "(?<![A-Za-z0-9])(?=[0-9a-z]*[A-Z])[A-Za-z0-9]+"
# Dictionaries of few keys name them in the plan: so many that are no words, and so many in all. The results are the same.
ODD_KEYS, LISTED_KEYS = 16, 256


def term_key(term: Column, symbol: Column) -> Column:
    """The key of a term. Symbols are whole mixed-case words and are their own first word."""
    word = F.regexp_extract(term, "[0-9a-z]+", 0)
    other = F.regexp_extract(term, OTHER_CHAR + r"[\s\S]?", 0)
    return F.when(symbol, F.regexp_extract(term, "[A-Za-z0-9]+", 0)).when(
        T.is_latin_term(term), word
    ).otherwise(other)


def _char_class(chars) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(chars)) + "]"


def text_keys(lower: Column, raw: Column | None = None, keys: list[str] | None = None) -> Column:
    """Distinct keys of a text: its words, the pairs and singles starting with any other
    character, a marker for punctuation-only terms, and the words holding a capital letter.

    With the list of keys a dictionary uses, characters none of them starts with are skipped.
    """
    pair_start = single = OTHER_CHAR
    capital, marker = CAPITAL_WORD, True
    if keys is not None:
        odd = [k for k in keys if k and not k.isalnum() or not k.isascii()]
        pairs, singles = {k[0] for k in odd if len(k) > 1}, {k for k in odd if len(k) == 1}
        pair_start = _char_class(pairs) if pairs else None
        single = _char_class(singles) if singles else None
        marker = "" in keys
        # Where all words with a capital begin with one, those that begin with the same ones are all that is asked for.
        firsts = {k[0] for k in keys if k and k.isascii() and not k.islower() and any("A" <= c <= "Z" for c in k)}
        if not firsts:
            raw = None
        elif all("A" <= c <= "Z" for c in firsts):
            capital = f"{_char_class(firsts)}(?<![A-Za-z0-9]{_char_class(firsts)})[A-Za-z0-9]*"
    parts = [F.split(lower, T.NO_WORD)]
    if keys is not None and 0 < len(odd) <= ODD_KEYS:
        # A pair or single stands among those of a text if the text contains it.
        parts.append(F.array_compact(F.array(*[F.when(F.contains(lower, F.lit(k)), F.lit(k)) for k in odd])))
        pair_start = single = None
    if pair_start:
        parts.append(F.regexp_extract_all(lower, F.lit(f"(?=({pair_start}[\\s\\S]))"), F.lit(1)))
    if single:
        parts.append(F.regexp_extract_all(lower, F.lit(f"({single})"), F.lit(1)))
    if marker:
        parts.append(F.array(F.lit("")))
    if raw is not None:
        parts.append(F.regexp_extract_all(raw, F.lit(capital), F.lit(0)))
    every = F.concat(*parts)
    if keys is not None and 0 < len(keys) <= LISTED_KEYS:
        return F.array_intersect(every, F.array(*[F.lit(k) for k in sorted(set(keys))]))
    return F.array_distinct(every)


def match_terms(texts: DataFrame, terms: DataFrame, keep: list[str], lower: str = "lower_text",
                raw: str | None = None, text_id: list[str] | None = None) -> DataFrame:
    """Texts joined with the terms they contain, one row per (text, term).

    ``terms`` needs ``term`` (normalised) and may have ``kind``; its other columns come along.
    A dictionary of proven size is broadcast and the text rides along inside the task. A larger
    one joins on keys alone; only candidates that need the text meet it again, by ``text_id``.
    """
    symbol = (F.col("kind") == "symbol") if "kind" in terms.columns else F.lit(False)
    keyed = terms.withColumn("_key", term_key(F.col("term"), symbol))
    small, listed = inlined(keyed)
    keyed = keyed if small is None else small
    known = None if small is None else [r["_key"] for r in listed]
    guard = F.col("guard") if "guard" in terms.columns else F.lit("")
    whole_word = (F.col("term") == F.col("_key")) & (guard == "")
    found = F.when(
        T.is_latin_term(F.col("term")),
        F.contains(F.col("_low"), F.lower(F.col("term"))) & F.rlike(F.col("_low"), T.bounded_pattern(F.col("term"))),
    ).otherwise(F.contains(F.col("_low"), F.col("term")))
    if raw:
        bounded = F.concat(F.lit(r"(?<![A-Za-z0-9])"), guard, F.lit(r"\Q"), F.col("term"),
                           F.lit(r"\E(?![A-Za-z0-9])"))
        found = F.when(symbol, F.rlike(F.col("_raw"), bounded)).otherwise(found)
    body = [F.col(lower).alias("_low"), *([F.col(raw).alias("_raw")] if raw else [])]
    keys = F.explode(text_keys(F.col(lower), F.col(raw) if raw else None, known)).alias("_key")
    if small is not None:
        joined = texts.select(*keep, *body, keys).join(F.broadcast(keyed), "_key")
        return joined.filter(whole_word | found).drop("_key", "_low", "_raw")
    ids = text_id or keep
    candidates = texts.select(*keep, keys).join(keyed, "_key")
    verified = candidates.filter(~whole_word).join(texts.select(*ids, *body), ids).filter(found)
    return candidates.filter(whole_word).drop("_key").unionByName(
        verified.drop("_key", "_low", "_raw"))


def normalised(texts: DataFrame, dictionary: Dictionary | None = None, text: str = "text") -> DataFrame:
    """Adds ``raw_text`` (width-folded) and ``lower_text`` (lower case, traps blanked)."""
    raw = T.norm_text(text)
    low = F.lower(raw)
    if dictionary is not None:
        texts = texts.withColumn("_traps", trap_phrases(dictionary))
        low = T.mask_phrases(low, F.col("_traps"))
    return texts.withColumns({"raw_text": raw, "lower_text": low}).drop("_traps")


def has_context(texts: DataFrame, dictionary: Dictionary, keep: list[str], text: str = "text") -> DataFrame:
    """Semi-join keeping the texts that hold at least one context word."""
    low = texts.withColumn("lower_text", F.lower(T.norm_text(text)))
    words = dictionary.context_words.select(F.lower("word").alias("term")).distinct()
    return match_terms(low, words, keep).select(*keep).distinct()


def extract(texts: DataFrame, dictionary: Dictionary, tracked: DataFrame | None = None) -> DataFrame:
    """Mentions of dictionary entities in texts.

    Input: source_type, source_id, note_id, text, content_time_ms, targeted (ticker or NULL).
    Output: ticker, source_type, source_id, note_id, matched_alias, match_basis, content_time_ms.
    Only hits are shuffled, once, by source; the per-source steps reuse that partitioning and
    hold at most one row per dictionary entry.
    """
    source = ["source_type", "source_id"]
    keep = [*source, "note_id", "content_time_ms", "targeted"]
    hits = match_terms(
        normalised(texts, dictionary), match_terms_of(dictionary, tracked), keep,
        raw="raw_text", text_id=source,
    )
    is_context = F.col("kind") == "context"
    hit = F.struct("ticker", "alias", "kind", "ord", "collision", "supersedes")
    per_source = hits.groupBy(*source).agg(
        F.first("note_id").alias("note_id"),
        F.first("content_time_ms").alias("content_time_ms"),
        F.first("targeted").alias("targeted"),
        F.bool_or(is_context).alias("ctx"),
        F.collect_list(F.when(~is_context, hit)).alias("hits"),
    )
    rows = per_source.select(*keep, "ctx", F.inline("hits"))
    aimed = F.col("targeted").eqNullSafe(F.col("ticker"))
    gated = F.col("ctx") | aimed
    basis = (
        F.when(F.col("kind") == "safe", "safe_alias")
        .when((F.col("kind") == "symbol") & (~F.col("collision") | F.col("ctx")), "ticker_symbol")
        .when((F.col("kind") == "ambiguous") & F.col("ctx"), "alias+context")
        .when(gated, "targeted_search")
    )
    ranked = rows.withColumn("match_basis", basis).filter("match_basis IS NOT NULL")
    first = F.min_by(
        F.struct("alias", "match_basis", "note_id", "content_time_ms", "supersedes"),
        F.struct(-strength(F.col("match_basis")), F.col("ord"), F.col("alias")),
    )
    best = ranked.groupBy(*source, "ticker").agg(first.alias("m"))
    dropped = F.flatten(F.collect_list("m.supersedes").over(Window.partitionBy(*source)))
    return (
        best.withColumn("_dropped", dropped)
        .filter(~F.array_contains("_dropped", F.col("ticker")))
        .select("ticker", *source, F.col("m.note_id"), F.col("m.alias").alias("matched_alias"),
                F.col("m.match_basis"), F.col("m.content_time_ms"))
    )


def strength(basis: Column) -> Column:
    out = F.lit(0)
    for name, value in K.STRENGTH.items():
        out = F.when(basis == name, F.lit(value)).otherwise(out)
    return out


def mention_texts(notes: DataFrame, comments: DataFrame, cutoff_ms: int,
                  queries: DataFrame | None = None) -> DataFrame:
    """Window notes and comments as matcher input; comments inherit their note's keyword."""
    n = notes.filter(F.col("publish_time_ms") >= cutoff_ms).select(
        F.lit("note").alias("source_type"), F.col("note_id").alias("source_id"), "note_id",
        F.concat(F.coalesce("title", F.lit("")), F.lit("\n"),
                 F.coalesce("note_desc", F.lit(""))).alias("text"),
        F.col("publish_time_ms").alias("content_time_ms"), "source_keyword",
    )
    c = comments.filter(F.col("create_time_ms") >= cutoff_ms).join(
        notes.select("note_id", "source_keyword"), "note_id"
    ).select(
        F.lit("comment").alias("source_type"), F.col("comment_id").alias("source_id"), "note_id",
        F.coalesce("content", F.lit("")).alias("text"),
        F.col("create_time_ms").alias("content_time_ms"), "source_keyword",
    )
    both = n.unionByName(c)
    if queries is None:
        return both.withColumn("targeted", F.lit(None).cast("string")).drop("source_keyword")
    keys = queries.select("query_key", F.col("ticker").alias("targeted"))
    return both.join(
        keys, F.lower(F.trim(F.coalesce("source_keyword", F.lit("")))) == F.col("query_key"), "left"
    ).drop("query_key", "source_keyword")


def extract_mentions(notes: DataFrame, comments: DataFrame, dictionary: Dictionary, window_ms: int,
                     now_ms: int, tracked: DataFrame | None = None,
                     run_id: int | None = None, facts: bool = False) -> DataFrame:
    """One pass of the matcher over the window. With ``facts`` each mention also tells what heat and evidence ask of its text: the
    one time that texts which name something meet their mentions."""
    queries = tracked_queries(dictionary, tracked) if tracked is not None else None
    texts = mention_texts(notes, comments, now_ms - window_ms, queries)
    found = extract(texts, dictionary, tracked).withColumn("run_id", F.lit(run_id).cast("bigint"))
    return with_facts(found, notes, comments) if facts else found


def refresh_mentions(existing: DataFrame, produced: DataFrame, cutoff_ms: int) -> DataFrame:
    """Merge a pass into the mention table.

    A stronger basis replaces alias, basis and facts; time and run of the first insert stay; rows in
    the window that the pass no longer produces are gone; older rows are kept.
    """
    key = ["ticker", "source_type", "source_id"]
    told = ["facts"] if "facts" in existing.columns and "facts" in produced.columns else []
    names = [*key, "note_id", "content_time_ms", "run_id", "matched_alias", "match_basis", *told]
    both = existing.select(*names, F.lit(0).alias("_new")).unionByName(produced.select(*names, F.lit(1).alias("_new")))
    merged = both.groupBy(*key).agg(
        F.min_by(F.struct("note_id", "content_time_ms", "run_id"), "_new").alias("first"),
        F.min_by(F.struct("matched_alias", "match_basis", *told),
                 F.struct(-strength(F.col("match_basis")), F.col("_new"))).alias("best"),
        F.max("_new").alias("_new"),
    )
    return merged.filter((F.col("_new") == 1) | (F.col("first.content_time_ms") < cutoff_ms)).select(
        *key, "first.note_id", "best.matched_alias", "best.match_basis",
        "first.content_time_ms", "first.run_id", *[f"best.{c}" for c in told],
    )


def stale_mentions(existing: DataFrame, produced: DataFrame, cutoff_ms: int) -> DataFrame:
    """Rows of the window that the latest pass did not produce."""
    key = ["ticker", "source_type", "source_id"]
    return existing.filter(F.col("content_time_ms") >= cutoff_ms).join(produced, key, "left_anti")


def topic_hits(texts: DataFrame, dictionary: Dictionary, keep: list[str], text: str = "text") -> DataFrame:
    """Distinct (text, tag) pairs."""
    low = texts.withColumn("lower_text", F.lower(T.norm_text(text)))
    terms = dictionary.topics.select(
        "ord", "tag", F.explode(F.transform("aliases", lambda a: F.lower(a))).alias("term")
    ).filter("term <> ''").withColumnRenamed("ord", "tag_ord")
    return match_terms(low, terms, keep).select(*keep, "tag_ord", "tag").distinct()


def topic_breakdown(notes: DataFrame, dictionary: Dictionary, window_ms: int, now_ms: int) -> DataFrame:
    """Canonical notes of the window per topic: mentions and likes."""
    texts = notes.filter(
        (F.col("publish_time_ms") >= now_ms - window_ms) & F.col("dup_group_id").isNull()
    ).select("note_id", "liked_count", F.concat_ws(
        " ", *[F.when(F.col(c) != "", F.col(c)) for c in ("title", "note_desc", "tag_list")]
    ).alias("text"))
    return topic_hits(texts, dictionary, ["note_id", "liked_count"]).groupBy("tag").agg(
        F.count(F.lit(1)).alias("mentions"),
        F.sum(F.coalesce("liked_count", F.lit(0))).alias("likes"),
    ).orderBy(F.desc("mentions"), F.desc("likes"), "tag")
