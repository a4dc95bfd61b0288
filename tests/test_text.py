from pyspark.sql import functions as F

from crowdgauge.functions import python_text as P
from crowdgauge.functions import text as T
from crowdgauge.functions import values as V


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "s string").select(fn(F.col("s"))).first()[0]


def test_counts(spark):
    cases = {"1.2万": 12000, "10+": 10, "1.5亿": 150000000, "1,234": 1234, "赞": 0, "": 0, None: 0, "3K": 3000}
    for text, want in cases.items():
        assert one(spark, text, V.parse_count) == want


def test_times(spark):
    assert one(spark, "1700000000", V.normalize_ts) == 1700000000000
    assert one(spark, "1700000000123", V.normalize_ts) == 1700000000123
    for bad in (None, "0", "-5", "soon"):
        assert one(spark, bad, V.normalize_ts) is None


def test_width_and_exact_normalisation(spark):
    assert one(spark, "ＮＶＤＡ　涨！", T.norm_text) == "NVDA 涨!"
    assert one(spark, "café ㎏ ①", P.nfkc) == "café kg 1"


def test_note_text_and_tags(spark):
    df = spark.createDataFrame([("T  x", "T x rest"), ("A", "B"), (None, " c　d ")], "t string, d string")
    assert [r[0] for r in df.select(T.note_text("t", "d")).collect()] == ["T x rest", "A B", "c d"]
    assert one(spark, "#闪迪[话题]# 好", T.clean_tags) == "#闪迪 好"
    assert one(spark, "#闪迪[话题]#好", T.strip_hashtags) == " 好"


def test_substance_counts_cjk_double(spark):
    assert one(spark, "Is That True？", T.substance) == 10
    assert one(spark, "海力士暴涨13%，美股创新高！", T.substance) == 22
    assert one(spark, "#美股 @某人 [笑哭R] https://a.b/c", T.substance) == 0


def test_terms_by_boundary(spark):
    df = spark.createDataFrame([("arm farmer arm", "arm"), ("farmer", "arm"), ("女大学生", "女大"), ("a é b", "é")], "x string, a string")
    got = df.select(T.has_term("x", "a"), T.term_position("x", "a"), T.term_count("x", "a")).collect()
    assert [tuple(r) for r in got] == [(True, 0, 2), (False, -1, 0), (True, 0, 1), (True, 2, 1)]


def test_excerpt_windows_late_mentions(spark):
    text = "H" * 70 + "x" * 900 + "NAME" + "y" * 300
    df = spark.createDataFrame([(text, 970), (text, -1), ("short", 0)], "s string, p int")
    late, none, short = [r[0] for r in df.select(T.excerpt("s", "p")).collect()]
    assert late.startswith("H" * 60 + "…") and "NAME" in late and late.endswith("…")
    assert none == text[:300] and short == "short"


def test_masking_keeps_length(spark):
    got = one(spark, "女大学生买女大", lambda c: T.mask_phrases(c, F.array(F.lit("女大学生"))))
    assert len(got) == 7 and got.endswith("买女大") and "女大学" not in got


def simhash(text, size=2):
    import hashlib

    grams = [text[i:i + size] for i in range(len(text) - size + 1)] or ([text] if text else [])
    out = 0
    for bit in range(64):
        vote = sum(1 if int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big") >> bit & 1 else -1 for g in grams)
        out |= (vote > 0) << bit
    return out - (1 << 64) if out >= 1 << 63 else out


def test_simhash_preset_against_brute_force(spark):
    for text in ("", "a", "ab", "海力士还能上车吗", "the same words again and the same words"):
        assert one(spark, text, P.simhash64) == simhash(text)
