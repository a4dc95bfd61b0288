"""Quote checks: numbers back to text, and verbatim containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T


def quotes_from_ids(submissions: DataFrame, items: DataFrame, ids: str = "ids",
                    k: int = K.MAX_QUOTES) -> DataFrame:
    """(submission_id, quotes): the texts of the cited item numbers, in the given order, without
    repeats or invented numbers, at most k."""
    cited = submissions.select("submission_id", "ticker", F.posexplode(F.array_distinct(ids)).alias("pos", "item_no"))
    found = cited.join(items.select("ticker", "item_no", "text"), ["ticker", "item_no"])
    pairs = F.array_sort(F.collect_list(F.struct("pos", "text")))
    quotes = found.groupBy("submission_id").agg(
        F.slice(F.transform(pairs, lambda x: x["text"]), 1, k).alias("quotes"))
    return submissions.select("submission_id", "ticker").join(quotes, "submission_id", "left").withColumn(
        "quotes", F.coalesce("quotes", F.array().cast("array<string>")))


def verify_quotes(quotes: DataFrame, items: DataFrame) -> DataFrame:
    """Quotes with ``kept``: is the quote contained in one of its entity's items (≤ 60), after
    removing everything but letters and digits?"""
    q = quotes.withColumn("needle", T.norm_for_hash("quote"))
    i = items.select("ticker", T.norm_for_hash("text").alias("hay"))
    hit = q.filter("needle <> ''").join(
        i, (q["ticker"] == i["ticker"]) & F.contains(i["hay"], q["needle"]), "left_semi"
    ).select("quote_id").withColumn("kept", F.lit(True))
    return quotes.join(hit, "quote_id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


GRAM_SIZES = (1, 2, 4, 8, 16, 32)


def _gram_size(needle: Column) -> Column:
    size = F.lit(GRAM_SIZES[0])
    for n in GRAM_SIZES[1:]:
        size = F.when(F.length(needle) >= 2 * n - 1, F.lit(n)).otherwise(size)
    return size


def find_quotes(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """(quote_id, text_id) pairs where a text of the whole corpus contains the quote verbatim.

    A text is cut into consecutive blocks of n characters; a quote of at least 2n − 1 characters
    must cover one whole block wherever it occurs, so it offers its n possible opening blocks.
    An equi-join on the block leaves few candidates for the exact test. The short side offers
    many keys, the corpus only 1/n of its length.
    """
    q = quotes.select("quote_id", T.norm_for_hash("quote").alias("needle")).filter("needle <> ''")
    q = q.withColumn("size", _gram_size(F.col("needle")))
    sizes = q.agg(F.sort_array(F.collect_set("size")).alias("s")).scalar()
    asked = q.select("quote_id", "needle", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.least("size", F.length("needle") - F.col("size") + 1)),
        lambda p: F.substring(F.col("needle"), p, F.col("size"))))).alias("gram"))
    blocks = F.array_distinct(F.flatten(F.transform("_sizes", lambda n: F.regexp_extract_all(
        F.col("hay"), F.concat(F.lit(".{"), n.cast("string"), F.lit("}")), F.lit(0)))))
    offered = texts.select("text_id", T.norm_for_hash("text").alias("hay")).withColumn(
        "_sizes", sizes).select("text_id", "hay", F.explode(blocks).alias("gram"))
    return offered.join(asked, "gram").filter(F.contains("hay", F.col("needle"))).select(
        "quote_id", "text_id").distinct()


def verify_corpus_quotes(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """Quotes with ``kept``: does any text of the corpus contain them?"""
    hit = find_quotes(quotes, texts).select("quote_id").distinct().withColumn("kept", F.lit(True))
    return quotes.join(hit, "quote_id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
