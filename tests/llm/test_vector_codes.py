"""Vector codes against plain rounds over all entries."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdgauge.llm import vector_codes as vc

ROW = "vec_id long, embedding array<float>, label int"


def brute(rows, parts, entries, rounds):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dim]
    width = -(-dim // parts)
    cut = [[(r[1] + [0] * (width * parts - dim))[p * width:(p + 1) * width] for r in kept] for p in range(parts)]
    books = [c[:entries] for c in cut]
    off = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda book, x: min(range(len(book)), key=lambda e: (off(book[e], x), e))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(books[p], x) for x in cut[p]]
            books[p] = [[sum(c) // len(c) for c in zip(*got)] if (got := [x for x, o in zip(cut[p], own) if o == e]) else old
                        for e, old in enumerate(books[p])]
    codes = [[near(books[p], cut[p][k]) for p in range(parts)] for k in range(len(kept))]
    errors = [sum(off(books[p][c[p]], cut[p][k]) for p in range(parts)) for k, c in enumerate(codes)]
    by_label = {}
    for (_, _, lab), e in zip(kept, errors):
        by_label[lab] = by_label.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((r[0] is None, r[0] or 0, "".join(f"{x:02x}" for x in c), e, by_label[r[2]], sha) for r, c, e in zip(kept, codes, errors)))


def got_of(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize(("dim", "spread", "block"), [(8, 1.0, 64), (8, 0.003, 50), (6, 0.2, 4096), (3, 0.01, 7)])
def test_equals_plain_rounds(spark, dim, spread, block):
    """Wide, tied and coarse components, widths that parts don't divide, repeated rows and ids, rows to drop."""
    rng = random.Random(dim)
    rows = [(rng.randrange(400), [rng.choice([-1, 1]) * rng.random() * spread for _ in range(dim)], rng.choice([None, 0, 1, 2])) for _ in range(300)]
    rows += rows[:20] + [(500 + k, [0.5 * spread] * dim, 3) for k in range(90)] + [(None, [0.1] * dim, None)]
    rows += [(1, None, 1), (2, [None] * dim, 1), (3, [float("nan")] * dim, 1), (4, [float("inf")] * dim, 2), (600, [1.0], 2), (601, [], None)]
    docs = spark.createDataFrame(rows, ROW).repartition(3)
    for c in ("v", "points", "trees", "code", "error", "part", "entry", "n", "l"):
        docs = docs.withColumn(c, F.lit("x"))
    got = got_of(vc.vector_codes(docs, entries=20, rounds=3, block=block))
    assert got == brute(rows, 4, 20, 3)


def test_fewer_vectors_than_entries_and_none(spark):
    rows = [(3, [0.1, 0.2, 0.3, 0.4], None), (3, [0.1, 0.2, 0.3, 0.4], 1)]
    assert got_of(vc.vector_codes(spark.createDataFrame(rows, ROW))) == brute(rows, 4, 256, 4)
    assert vc.vector_codes(spark.createDataFrame([], ROW)).collect() == []
    empty = vc.vector_codes(spark.createDataFrame([(1, [], 1), (2, None, 1), (5, [1e30], 1)], ROW)).collect()
    assert [(r.vec_id, r.code, r.error) for r in empty] == [(1, "00000000", 0)]


def test_whole_nodes_are_assigned_by_cached_sums():
    rng = np.random.default_rng(1)
    middles = rng.integers(-5000, 5000, (16, 8))
    points = (middles[rng.integers(0, 16, 3000)] + rng.integers(-20, 20, (3000, 8))).astype(np.int64)
    tree = vc.tree_of(points, 16)
    codes, whole = vc.assigned(points, tree, middles)
    off = ((points[:, None] - middles[None]) ** 2).sum(2)
    assert (codes == off.argmin(1)).all()
    covered = sum(tree.end[n] - tree.start[n] for n, _ in whole)
    assert covered > 2000 and len(whole) < 500
    counts, sums = vc.summed(points, tree, middles)
    assert (counts == np.bincount(codes, minlength=16)).all() and (sums.sum(0) == points.sum(0)).all()
