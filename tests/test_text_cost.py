"""Texts are prepared once a text and a part, and the cheaper forms say the same as the plain ones."""

import random
import re

from pyspark.sql import functions as F

from crowdgauge import constants as K
from crowdgauge.functions import text as T
from crowdgauge.operators import dedup, evidence, matching
from crowdgauge.operators.facts import with_facts
from tests.test_facts import tables


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_substance_names_its_patterns_once(spark):
    texts = spark.createDataFrame([("a plain text",), ("#tag[话题]# and @you https://x.y/z [smile] ＷＩＤＥ",)], "s string")
    plan = plan_of(texts.filter(T.substance("s") >= 5))
    assert plan.count("https?://") == 1
    assert [r[0] for r in texts.select(T.substance("s")).collect()] == [10, 7]


def test_opening_tells_substance_of_long_texts(spark):
    rnd = random.Random(5)
    parts = ["#" + "x" * 30 + "[话题]#", "#y", "@" + "h" * 20, "[" + "e" * 12 + "]", "https://" + "u" * 60, "word ", "中", "，", " ", "ab", "\n"]
    cases = ["".join(rnd.choice(parts) for _ in range(n)) for n in (0, 3, 40, 200, 400)]
    # Openings whose end falls into each part of a sign, with next to nothing before and behind.
    for sign in parts[:5]:
        cases += ["，" * (T.OPENING - at) + sign for at in range(0, len(sign), 3)]
        cases += [" a" * 20 + "，" * (T.OPENING - 40 - at) + sign * 3 for at in range(0, len(sign), 7)]
    df = spark.createDataFrame([(c,) for c in [*cases, None]], "s string")
    for most in (1, 20, 60):
        for r in df.select("s", T.substance("s").alias("n"), T.substance_up_to("s", most).alias("m")).collect():
            assert r.m == r.n if r.n < most else r.m >= most, r


def test_bounded_terms_begin_with_the_term(spark):
    texts = ["arm farmer arm", "a.b a.bc xa.b a.b", "aa aaa a-a aa", "", "arm", "xarm", "arm9 arm"]
    df = spark.createDataFrame([(t, a) for t in texts for a in ("arm", "a.b", "aa")], "t string, a string")
    for r in df.select("t", "a", T.term_position("t", "a").alias("at"), T.term_count("t", "a").alias("n"), T.bounded_pattern("a").alias("p")).collect():
        want = [m.start() for m in re.finditer(f"(?<![0-9a-z]){re.escape(r.a)}(?![0-9a-z])", r.t)]
        assert (r.at, r.n) == (want[0] if want else -1, len(want)), r
        assert r.p.startswith(f"\\Q{r.a}\\E")


def test_keys_of_a_listed_dictionary(spark):
    texts = ["The THN rose, xTHN THNx 3M iPod", "", "lé ément é", "-- &", "Thon thon THON", "en é", "né"]
    df = spark.createDataFrame([(t,) for t in texts], "raw string").withColumn("low", F.lower("raw"))
    every = [set(r[0]) for r in df.select(matching.text_keys(F.col("low"), F.col("raw"))).collect()]
    for keys in (["THN", "thon", "ém", "é", ""], ["3M", "iPod", "en"], ["en"], ["é"], ["ñ" + chr(97 + i) for i in range(20)] + ["é"]):
        got = df.select(matching.text_keys(F.col("low"), F.col("raw"), keys)).collect()
        for (found,), whole, text in zip(got, every, texts, strict=True):
            assert len(found) == len(set(found)) and set(found) & set(keys) == whole & set(keys), (text, keys)
            assert set(found) <= set(keys)


def test_titles_are_cleaned_once_a_text(spark):
    notes, comments, mentions = tables(spark)
    plan = plan_of(with_facts(mentions, notes, comments))
    above = plan[:plan.index("Generate")]
    assert "[话题]" not in above and "regexp_replace" not in above


def test_substance_of_notes_is_told_behind_the_cap(spark):
    notes, comments, mentions = tables(spark)
    comments = comments.withColumn("content_norm_hash", F.lit(None).cast("string"))
    told = with_facts(mentions, notes, comments).localCheckpoint()
    items = evidence.gather(told, notes, comments, 1_000, 1_000)
    rows = items.withColumn("whole", T.substance("text")).filter("type = 'note'").collect()
    assert rows and all(r.substance == r.whole >= K.MIN_NOTE_SUBSTANCE for r in rows)
    assert "item_no" in plan_of(items)


def test_texts_are_normalised_once_to_mark_copies(spark):
    rows = [("a", "One, two!", 5, 10), ("b", "one TWO", 9, 10), ("c", "one two", 9, 8), ("d", None, 1, 9), ("e", "", 2, 9), ("f", "other", 0, 9),
            ("a", "other", 3, 9), (None, "other.", None, 9), ("g", "one two", 50, 1), ("b", "one TWO", 9, 10)]
    items = spark.createDataFrame(rows, "id string, text string, likes long, at long").withColumn("_norm", T.norm_for_hash("text"))
    plain, got = [dedup.mark_exact(items, "_norm", "id", "likes", "at", 5, 10, source=s) for s in (None, "text")]
    assert sorted(map(str, plain.collect())) == sorted(map(str, got.collect()))
    assert {(r.id, r.text, r.dup_group_id) for r in got.collect() if r.dup_group_id} == {
        ("a", "One, two!", "c"), ("b", "one TWO", "c"), ("d", None, "e"), ("f", "other", "a")}
    assert "split(" not in plan_of(got.drop("_norm"))
