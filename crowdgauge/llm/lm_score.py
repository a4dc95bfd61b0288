"""LM scoring: stupid-backoff scores of whole texts, computed relationally.

A word scores count(n-gram) / count(the words before it); where the n-gram was counted less than ``least`` times, or never, ``alpha``
times the score by one word less, down to count(w) / N. Words are never left out.

Places with ``order`` - 1 words before them are dealt by the hash of those words, each as one narrow row: how often the words before and
the whole n-gram were counted is told where the row lies, so that one exchange gives counts and scores. Terms fold to sums of a text.
Places near the beginning of a text, which have fewer words before them, and those whose n-gram was not found go on together: they
ask for all their shorter n-grams, whose counts come of one more scan behind a filter of what is asked, and take the longest that was
found. Only texts that were not counted (``counted``), or ``least`` > 1, leave places without their n-gram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, filter_table, id_and_text, written

WORD = r"[^\x20\x09-\x0D]+"
ALPHA = 0.4
LEAST = 1  # no count is left out unless a caller asks for it
ORDER = 3
NEXT_BITS = 48  # of the next word's hash, which tells words apart behind the same words before; the rest of the field holds a part of the row


def word_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, h): the hashes of each text's words. ``row`` tells rows apart that repeat an id."""
    words = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(0))
    return id_and_text(docs, id_col, text_col).select("doc_id", F.monotonically_increasing_id().alias("row"),
                                                      F.transform(words, lambda w: F.xxhash64(w)).alias("h"))


def at_places(order: int) -> Column:
    """For each place the words from there on, as fields h0, h1, ...; null beyond the end of the text. The last element has none."""
    h = F.concat("h", F.array(F.lit(None).cast("long")))
    return F.arrays_zip(*[F.slice(h, k + 1, F.size(h)).alias(f"h{k}") for k in range(order)])


def gram(first: int, size: int) -> Column:
    """Hash of the ``size`` words from field ``first`` on; the size goes in, so orders share one table. Only for words that are there."""
    return F.xxhash64(F.lit(size), *[F.col(f"h{k}") for k in range(first, first + size)])


def dealt(rows: DataFrame, order: int, words: bool) -> DataFrame:
    """(key, tail, rest, more): what is dealt by ``key``, the hash of the words before. One row for each place that has ``order`` - 1 words before
    it, one for the words that end a text (no ``tail``), one for the text itself, whose ``more`` holds its id and its beginning. With
    ``words`` that of places holds their words."""
    begin = [f"s{k}" for k in range(order - 1)]
    at = rows.select("row", "doc_id", F.size("h").alias("n"), *[F.get("h", F.lit(k)).alias(c) for k, c in enumerate(begin)],
                     F.explode(at_places(order)).alias("p")).select("row", "doc_id", "n", *begin, "p.*")
    own, last = F.col("h0").isNull(), F.col(f"h{order - 1}")
    key = F.when(own, F.xxhash64("row")).otherwise(gram(0, max(order - 1, 1)))
    # The hash of the next word and the low bits of the row share a field; what is left of the row is the same for many rows on end.
    tail = F.shiftleft("row", NEXT_BITS).bitwiseOR(last.bitwiseAND(F.lit((1 << NEXT_BITS) - 1)))
    none = F.lit(None).cast("long")
    fields = lambda row, doc_id, n, w: F.struct(row.alias("row"), doc_id.alias("doc_id"), n.cast("long").alias("n"), *[c.alias(f"h{k}") for k, c in enumerate(w)])
    more = F.when(own, fields(F.col("row"), F.col("doc_id"), F.col("n"), [*map(F.col, begin), none]))
    if words:
        more = F.when(last.isNotNull(), fields(none, none, none, [F.col(f"h{k}") for k in range(order)])).otherwise(more)
    return at.filter(own | F.col(f"h{max(order - 2, 0)}").isNotNull()).select(
        key.alias("key"), tail.alias("tail"), F.shiftright("row", 64 - NEXT_BITS).alias("rest"), more.alias("more"))


def told(rows: DataFrame, base: DataFrame | None, order: int, least: int) -> DataFrame:
    """(row, doc_id, n, h0, h1, ..., s, places): the sum of each text over the places whose n-gram was found, the text itself with its beginning (``n``
    is not null), and the places whose n-gram was not found, with their words."""
    if base is None:
        sent, counts, asks = dealt(rows, order, least > 1), F.lit(True), F.lit(True)
    else:
        sent = dealt(rows, order, True).withColumn("asks", F.lit(True)).unionByName(dealt(base, order, True).filter("more.n is null").withColumns({
            "asks": F.lit(False), "more": F.lit(None)}))
        counts, asks = ~F.col("asks"), F.col("asks")
    own = F.col("more.n").isNotNull()
    n = F.count(F.when(counts & ~own, 1))
    met = sent.repartition("key").withColumn("next", F.col("tail").bitwiseAND(F.lit((1 << NEXT_BITS) - 1)))
    met = met.withColumn("c", n.over(Window.partitionBy("key", "next"))).withColumn("before", n.over(Window.partitionBy("key")))
    row = F.when(own, F.col("more.row")).otherwise(F.shiftleft("rest", 64 - NEXT_BITS).bitwiseOR(F.shiftrightunsigned("tail", NEXT_BITS)))
    if order > 1:
        # Where the n-gram was counted as often as the words before it, the place adds log 1.
        found, term, adds = F.col("c") >= least, F.log(F.col("c").cast("double")) - F.log(F.col("before").cast("double")), F.col("c") != F.col("before")
    else:
        found, term, adds = F.lit(True), F.log(F.greatest("c", F.lit(1)).cast("double")), F.lit(True)
    return met.filter(asks & (own | (F.col("tail").isNotNull() & (~found | adds)))).select(
        row.alias("row"), "more.doc_id", "more.n", *[F.when(own | ~found, F.col(f"more.h{k}")).alias(f"h{k}") for k in range(order)],
        F.when(~own & found, term).otherwise(F.lit(0.0)).alias("term"), (~own & found).alias("found")).groupBy(
        "row", "doc_id", "n", "found", *[f"h{k}" for k in range(order)]).agg(F.sum("term").alias("s"), F.count(F.lit(1)).alias("places")).drop("found")


def asked(rows: DataFrame, order: int) -> DataFrame:
    """(row, place, longest, places, slot, key): what the places ask whose n-gram has fewer than ``order`` words or was not found: their n-grams
    (slots 1, 2, ...) and the words before (slots -1, -2, ...). ``longest`` is the order they start from."""
    def of(at: int, longest: int, place: Column) -> Column:
        sizes = range(1, min(at + 1, order - 1) + 1)
        slots = [(k, at - k + 1, k) for k in sizes] + [(1 - k, at - k + 1, k - 1) for k in sizes if k > 1]
        return F.array(*[F.struct(place.alias("place"), F.lit(longest).alias("longest"), F.lit(slot).alias("slot"), gram(first, size).alias("key"))
                         for slot, first, size in slots])

    begins = [F.when(F.col("n") > at, of(at, at + 1, F.lit(at).cast("long"))) for at in range(order - 1)]
    missed = F.when(F.col("n").isNull(), of(order - 1, order, gram(0, order)))
    every = F.flatten(F.array_compact(F.array(*begins, missed)))
    return rows.select("row", "places", F.inline(every))


def gram_counts(base: DataFrame, order: int, least: int, wanted: DataFrame) -> DataFrame:
    """(key, c): how often the n-grams of up to ``order`` words among ``wanted`` stand in all texts; others with them, but few."""
    places = base.select(F.explode(at_places(order)).alias("p")).select("p.*")
    keys = F.array_compact(F.array(*[F.when(F.col(f"h{k - 1}").isNotNull(), F.struct(gram(0, k).alias("key"), F.lit(k).alias("size"))) for k in range(1, order + 1)]))
    every = places.select(F.inline(keys))
    found = filter_table(wanted)
    if found is not None:  # else as many n-grams are asked as a table of all would have
        table, bits = found
        every = every.withColumn("at", F.pmod(F.xxhash64("key"), F.lit(bits)))
        word = F.get(F.col("words"), F.expr("cast(shiftright(at, 6) & 511 AS int)"))
        every = every.join(F.broadcast(table), F.expr("shiftright(at, 15)") == F.col("bucket")).filter(
            F.getbit(word, F.expr("cast(at & 63 AS int)")) == 1)
    counted = every.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("size").alias("size"))
    return counted.filter((F.col("size") == 1) | (F.col("c") >= least)).select("key", "c")


def backed_off(asks: DataFrame, counts: DataFrame, order: int, alpha: float, n: int) -> DataFrame:
    """(row, s): of each place the longest n-gram that was found, ``alpha`` for each word less. A word never counted counts as one."""
    slots = [*range(1, order), *range(2 - order, 0)]
    by_place = asks.join(counts, "key", "left").groupBy("row", "place", "longest").agg(
        F.max("places").alias("places"), *[F.max(F.when(F.col("slot") == k, F.col("c"))).cast("double").alias(f"c{k}") for k in slots])
    backs = lambda k: (F.col("longest") - k) * F.log(F.lit(alpha))
    term = F.coalesce(*[F.log(F.col(f"c{k}")) - F.log(F.col(f"`c{1 - k}`")) + backs(k) for k in range(order - 1, 1, -1)],
                      F.log(F.coalesce("c1", F.lit(1.0))) - F.log(F.lit(float(n))) + backs(1))
    return by_place.groupBy("row").agg(F.sum(F.col("places") * term).alias("s"))


def lm_scores(docs: DataFrame, alpha: float = ALPHA, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text",
              order: int = ORDER, counted: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score), one row per input row.

    The n-grams are those of ``counted`` (same columns), or of the scored texts themselves. A-Z are lower-cased, words are cut at ASCII
    white space. A text's first words score by the n-grams they have, its first word count(w) / N. ``least`` = 1 keeps all counts. Null, empty and blank texts
    have no words and null scores. Repeated rows count and get a row each; a null id stays null; other columns are not read; no rows in, no rows out."""
    if order < 1 or least < 1:
        raise ValueError("order and least are 1 or more")
    rows = word_rows(docs, id_col, text_col)
    base = None if counted is None else word_rows(counted, id_col, text_col)
    found = written(told(rows, base, order, least), "lm-places")
    n = (found.agg(F.sum("n")) if base is None else base.agg(F.sum(F.size("h")))).first()[0] or 1
    parts = found.select("row", "doc_id", "n", "s")
    if order > 1:
        asks = asked(found.filter("n > 0 or h0 is not null"), order)
        wanted = asks.select(F.col("key").alias("id")).distinct()
        terms = backed_off(asks, gram_counts(rows if base is None else base, order - 1, least, wanted), order, alpha, n)
        parts = parts.unionByName(terms, allowMissingColumns=True)
    sums = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n").alias("n_words"), F.sum("s").alias("s"))
    base_log = F.log(F.lit(float(n))) * F.col("n_words") if order == 1 else F.lit(0.0)
    score = F.when(F.col("n_words") > 0, F.col("s") - base_log)
    return sums.select("doc_id", "n_words", F.round(score, 6).alias("log_score"), F.round(score / F.col("n_words"), 6).alias("mean_log_score"))
