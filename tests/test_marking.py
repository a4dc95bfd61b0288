"""Marking of equal texts: by digests, each text normalised once a side; and the ranges that replace negated classes."""

import re

from pyspark.sql import functions as F

from crowdgauge.functions import text as T
from crowdgauge.operators import dedup

CLASSES = [(T.NO_WORD, "[^0-9a-z]"), (T.NO_WORD_OR_CJK, "[^0-9a-z\u4e00-\u9fff]"), (T.NO_WORD_OR_CJK_ANY_CASE, "[^0-9a-zA-Z\u4e00-\u9fff]")]


def test_ranges_equal_negated_classes(spark):
    codes = [c for c in range(0x11000) if not 0xD800 <= c < 0xE000] + [0x1F600, 0x20000, 0x10FFFF]
    rows = spark.createDataFrame([(c, chr(c)) for c in codes], "code int, c string").repartition(4)
    got = rows.select("code", *[F.rlike("c", F.lit(f"^{p}$")).alias(f"p{k}") for k, (p, _) in enumerate(CLASSES)]).collect()
    assert len(got) == len(codes)
    for r in got:
        assert list(r)[1:] == [re.fullmatch(q, chr(r["code"])) is not None for _, q in CLASSES], r


def test_marking_meets_by_digest_and_normalises_once(spark):
    texts = ["Same text!", "same TEXT", "other", "", "!!", None, None, "Same-text", "late same text"]
    rows = [(str(k), t, k % 4, 100 + k) for k, t in enumerate(texts)] + [("8", "same text", 50, 10), ("1", "other", 9, 101), (None, "other", 99, 500)]
    items = spark.createDataFrame(rows, "item string, body string, likes long, ts long")
    items = items.withColumn("norm", F.when(F.col("body").isNotNull(), T.norm_for_hash("body")))
    marked = dedup.mark_exact(items, "norm", "item", "likes", "ts", 1_000, 1_090)  # times from 90 on are inside
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_digest" in plan and "hashpartitioning(norm" not in plan
    assert "norm" in marked.columns and "_digest" not in marked.columns

    groups = {}
    for i, t, likes, ts in rows:
        if t is not None and ts >= 90:
            groups.setdefault(re.sub("[^0-9a-z]", "", t.lower()), []).append((-likes, ts, i or "", i))
    want = []
    for i, t, likes, ts in rows:
        g = [] if t is None or ts < 90 else groups[re.sub("[^0-9a-z]", "", t.lower())]
        top = min(g)[3] if len(g) > 1 else None
        want.append((i, t, ts, top if i is not None and top is not None and top != i else None))
    got = [(r["item"], r["body"], r["ts"], r["dup_group_id"]) for r in marked.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    out = dedup.mark_exact(items.select("norm", "item", "likes", "ts", "body"), "norm", "item", "likes", "ts", 1_000, 1_090).drop("norm")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
