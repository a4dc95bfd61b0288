"""The Arrow table function names what the batch matcher names."""

import pytest
from pyspark.sql import functions as F

from crowdgauge.operators import matching
from crowdgauge.operators.dictionary import Dictionary
from crowdgauge.session import small_table
from crowdgauge.streaming.udtf import register_match_mentions

STOCKS = [("BRK", "b", "s", None, ["berk"], ["shire"], [], None), ("BRK.B", "b", "s", None, [], ["b share"], ["BRK"], None),
          ("ABC", "a", "s", None, ["苹果", "big apple"], ["fruit", "a&b"], [], None), ("ab", "a", "s", None, [], [], [], None), ("X", "x", "s", None, [], ["ex"], [], None)]
TEXTS = ["BRK.B and ABC", "BRK then BRK.B", "xBRK.B", "brk.b", "ABC", "ABC money", "the fruit", "fruit money", "big apple pie", "big apple", "bigapple", "pine big apples",
         "吃苹果吧", "ＡＢＣ ｍｏｎｅｙ", "a&b money", "xa&b money", "shire", "X ex money", "ab", "", None, "berk, BRK money", "ABC.BRK.B money b share"]


def test_it_names_what_the_matcher_names(spark):
    d = Dictionary.from_rows(spark, STOCKS, ["money"], ["ABC"], ["apple pie"], [])
    rows = [("note", str(i), str(i), x, i, who) for i, x in enumerate(TEXTS) for who in [[None, "ABC", "BRK"][i % 3]]]
    texts = small_table(spark, rows, "source_type string, source_id string, note_id string, text string, content_time_ms bigint, targeted string")
    match = register_match_mentions(spark, d)
    got = match(texts.withColumn("text", F.col("text")).asTable())
    want = matching.extract(texts, d)
    assert {tuple(r) for r in got.select(*want.columns).collect()} == {tuple(r) for r in want.collect()} != set()
    assert match(texts.limit(0).asTable()).isEmpty()
    texts.createOrReplaceTempView("some_texts")
    assert spark.sql("SELECT * FROM match_mentions(TABLE(some_texts))").count() == want.count()


def test_a_dictionary_beyond_the_limit_is_an_error(spark):
    with pytest.raises(ValueError):
        register_match_mentions(spark, Dictionary.from_rows(spark, STOCKS), limit=3)
