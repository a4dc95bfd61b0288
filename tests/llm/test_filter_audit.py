"""The filter audit against a plain loop over documents and orders."""

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from crowdgauge.llm import filter_audit as audit

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    def fails(i, text):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        ids = [j for j, t, _ in rows if (t or "") == text and j is not None]
        return {f for f, bad in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            bool(re.search(r"[#$%&*|]", text)), any(i is None or j < i for j in ids))) if bad}

    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = [(i, p or "", fails(i, t)) for i, t, p in rows]
    out, orders = {}, ["".join(o) for o in permutations("ABCDE")]
    for part in {p for _, p, _ in docs}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in orders:
            left = [(i, f) for i, p, f in docs if p == part]
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                before = [1 for _, p, f in docs if p == part and letter in f and f & set(order[:step - 1])]
                left = [x for x in left if letter not in x[1]]
                shapley[letter] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(before), sum(p == part and f == {letter} for _, p, f in docs),
                                          sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), letter]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = shapley[v[-1]]
    return out


def got_of(df):
    return {(r.part, r.filter_order, r.step): [r[c] for c in audit.COUNTS] for r in df.collect()}


def test_equals_a_plain_loop(spark):
    long = " ".join(f"word{k}" for k in range(250))
    rows = [(5, long, "a"), (2, long, "b"), (9, long, "a"), (9, long, "a"), (None, long, "a"), (2, long, "b"), (3, "", None), (4, None, ""), (1, long + " $", "a"),
            (7, "x " * 300, "b"), (8, (long + " ") * 3, "b"), (10, long.upper(), "a"), (11, long + " #A B C", "c"), (12, "é\x85 ü\xa0 ABC", "c"), (None, "solo", "c"),
            (13, "word " * 20_000, "c"), (14, long.capitalize() + " | ", "b")]
    labels = [(5, 1, 0), (9, 1, 1), (9, 0, 0), (10, None, 1), (77, 1, 1), (None, 1, 1), (3, 1, None), (7, 0, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    for c in ("part", "mask", "digest", "n", "good", "toxic", "quality", "first", "i", "d"):
        docs = docs.withColumn(c, F.lit("x"))
    assert got_of(audit.filter_audit(docs.repartition(3), spark.createDataFrame(labels, LABELS))) == brute(rows, labels)


@pytest.mark.parametrize("rows", [[], [(1, None, None)]])
def test_empty_tables(spark, rows):
    got = got_of(audit.filter_audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], LABELS)))
    assert got == brute(rows, [])


def test_removal_steps_are_least_positions():
    import numpy as np

    positions = np.argsort(np.array(list(permutations(range(3)))), axis=1).T
    steps = audit.removal_steps(positions)
    for mask in range(8):
        for o in range(6):
            assert steps[mask, o] == min([positions[f, o] for f in range(3) if mask >> f & 1], default=3)
