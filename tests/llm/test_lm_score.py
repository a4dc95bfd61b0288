"""Stupid-backoff scores against a plain loop."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from crowdgauge.llm import lm_score
from crowdgauge.llm.queries import QUERIES


def test_scores_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choices(["A", "a", "b", "c", "d", f"x{k}"], k=rng.randrange(0, 12)))) for k in range(80)]
    rows += [(500, None), (501, ""), (502, " \n\t"), (503, "a b"), (503, "a b"), (None, "c d"), (504, "a " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("row", "pair", "word", "first", "c2", "key"):
        docs = docs.withColumn(c, F.lit("x"))
    words = [(t or "").lower().split() for _, t in rows]
    c1, c2 = Counter(w for x in words for w in x), Counter(p for x in words for p in zip(x, x[1:]))
    n, seen = sum(c1.values()), lambda w: c1[w] if c1[w] >= 2 else 1
    want = []
    for (i, _), x in zip(rows, words, strict=True):
        score = sum(math.log(c2[x[k - 1], w] / c1[x[k - 1]]) if k and c2[x[k - 1], w] >= 2 else math.log((0.4 if k else 1) * seen(w) / n) for k, w in enumerate(x))
        want.append((i, len(x), round(score, 3) if x else None, round(score / len(x), 4) if x else None))
    got = [(r[0], r[1], None if r[2] is None else round(r[2], 3), None if r[3] is None else round(r[3], 4)) for r in lm_score.lm_scores(docs, least=2, order=2).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert lm_score.lm_scores(docs.limit(0)).collect() == []


def stupid_backoff(words, order, least, alpha=0.4):
    """Log scores by a plain loop over all orders; only n-grams of two and more words need ``least`` counts."""
    counts = Counter(tuple(x[k:k + m]) for x in words for m in range(1, order + 1) for k in range(len(x) - m + 1))
    n = sum(map(len, words))

    def score(before, w):
        if not before:
            return counts[(w,)] / n
        c = counts[(*before, w)]
        return c / counts[before] if c >= least else alpha * score(before[1:], w)

    return [sum(math.log(score(tuple(x[max(0, k - order + 1):k]), w)) for k, w in enumerate(x)) if x else None for x in words]


@pytest.mark.parametrize(("order", "least"), [(3, 1), (2, 1), (1, 1), (4, 1), (3, 2), (4, 3), (1, 2)])
def test_orders_and_full_counts_equal_brute_force(spark, order, least):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(["A", "a", "b", "c", f"x{k}"], k=rng.randrange(0, 12)))) for k in range(60)]
    rows += [(500, None), (501, ""), (502, "a"), (503, "once"), (504, "a b"), (504, "a b"), (None, "c d e f"), (505, "a b c " * 2_000)]
    words = [(t or "").lower().split() for _, t in rows]
    want = [(i, len(x), s) for (i, _), x, s in zip(rows, words, stupid_backoff(words, order, least), strict=True)]
    got = [tuple(r)[:3] for r in lm_score.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), least=least, order=order).collect()]
    by = lambda r: (repr(r[0]), r[1], r[2] or 0.0)
    for g, w in zip(sorted(got, key=by), sorted(want, key=by), strict=True):
        assert g == (w[0], w[1], None if w[2] is None else pytest.approx(w[2], abs=1e-5))


def test_query_keeps_pairs_counted_once(spark, tmp_path):
    spark.createDataFrame([(1, "p q r"), (2, "p s t")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["log_score"] for r in QUERIES["op5_lm_scoring"](spark, str(tmp_path)).collect()}
    # count(p) / 6, then count(p q) / count(p), then count(p q r) / count(p q)
    assert got == {k: int((math.log(2 / 6) + math.log(1 / 2)) * 1e4) / 1e4 for k in (1, 2)}


@pytest.mark.parametrize(("order", "least"), [(3, 1), (4, 2), (2, 1), (1, 1)])
def test_texts_that_were_not_counted_back_off(spark, order, least):
    rng = random.Random(3)
    make = lambda k, letters: " ".join(rng.choices(letters, k=rng.randrange(0, 15)))
    known = [(k, make(k, "abcd")) for k in range(60)]
    rows = [(k, make(k, "Aabcdz")) for k in range(60)] + [(100, None), (101, "z"), (102, "a z"), (102, "a z"), (None, "a b c d z z z " * 50)]
    counts = Counter(tuple(x[k:k + m]) for _, t in known for x in [t.split()] for m in range(1, order + 1) for k in range(len(x) - m + 1))
    n = sum(len(t.split()) for _, t in known)

    def score(before, w):
        if not before:
            return max(counts[(w,)], 1) / n
        c = counts[(*before, w)]
        return c / counts[before] if c >= least else 0.4 * score(before[1:], w)

    words = [(t or "").lower().split() for _, t in rows]
    want = [(i, len(x), sum(math.log(score(tuple(x[max(0, k - order + 1):k]), w)) for k, w in enumerate(x)) if x else None) for (i, _), x in zip(rows, words, strict=True)]
    ddl = "doc_id long, text string"
    got = lm_score.lm_scores(spark.createDataFrame(rows, ddl), least=least, order=order, counted=spark.createDataFrame(known, ddl)).collect()
    by = lambda r: (repr(r[0]), r[1], r[2] or 0.0)
    for g, w in zip(sorted((tuple(r)[:3] for r in got), key=by), sorted(want, key=by), strict=True):
        assert g == (w[0], w[1], None if w[2] is None else pytest.approx(w[2], abs=1e-5))
