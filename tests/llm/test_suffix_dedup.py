"""Removal of repeated strings against a plain table of all windows; the transform against sorted suffixes."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from crowdgauge.llm.suffix_dedup import Collection, Cutter, suffix_dedup

ROW = "doc_id long, text string"


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    count = {}
    for t in texts:
        for k in range(len(t) - length + 1):
            count[t[k:k + length]] = count.get(t[k:k + length], 0) + 1
    out = []
    for (i, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if count[t[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone) if not g)
        out.append((i is None, i or 0, len(t), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got_of(df):
    rows = df.collect()
    for r in rows:
        assert sum(b - a for a, b in zip(r.kept_spans[::2], r.kept_spans[1::2])) == r.n_bytes - r.n_removed
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)


@pytest.mark.parametrize(("length", "alphabet", "hot", "group"), [(12, "ab", 2048, 8192), (20, "abcdefgh é", 3, 40), (8, "abcdefghijklmnop", 2, 16), (300, "xyz", 2048, 8192)])
def test_equals_all_windows(spark, length, alphabet, hot, group):
    """Random texts with shared passages, near and exact copies, runs of one byte, null, empty and short texts, repeated rows and ids."""
    rng = random.Random(length)
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    passages = [text(rng.randrange(length // 2, 4 * length)) for _ in range(6)]
    rows = [(k, text(rng.randrange(0, 3 * length)) + rng.choice(passages) + text(rng.randrange(0, 3 * length)) + rng.choice(passages + [""])) for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(5)] + [rows[7], (7, "other" + text(length)), (None, rows[3][1]), (None, None), (200, None), (201, ""), (202, "short")]
    rows += [(203, "q" * (5 * length)), (204, "é" * length), (205, "\x00" * length), (206, "pq" * length), (300, text(200 * length))]
    docs = spark.createDataFrame(rows, ROW).repartition(3)
    for c in ("id", "tk", "gram", "digest", "start", "size", "n", "sha", "n_bytes", "count"):
        docs = docs.withColumn(c, F.lit("x"))
    assert got_of(suffix_dedup(docs, length, hot=hot, group_segments=group)) == brute(rows, length)


def test_empty_table_and_nothing_shared(spark):
    assert suffix_dedup(spark.createDataFrame([], ROW)).collect() == []
    rows = [(1, None), (2, "a" * 100), (3, "b" * 199)]
    assert got_of(suffix_dedup(spark.createDataFrame(rows, ROW))) == brute(rows, 200)


@pytest.mark.parametrize("alphabet", [b"ab", bytes(range(256)), b"a"])
def test_transform_and_prefixes_equal_sorted_suffixes(alphabet):
    rng = random.Random(5)
    docs = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(0, 30))) for _ in range(25)]
    docs += docs[:3]
    got = Collection(docs, 6)
    suffixes = sorted((d[k:], i, k) for i, d in enumerate(docs) for k in range(len(d) + 1))

    def common(a, b):
        n = 0
        while n < min(len(a), len(b), 6) and a[n] == b[n]:
            n += 1
        return n

    rank = {x: k for k, x in enumerate(sorted(set(b"".join(docs))), 1)}
    assert got.transform().tolist() == [rank[docs[i][k - 1]] if k else 0 for _, i, k in suffixes]
    assert got.prefix.tolist() == [0] + [common(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:])]
    windows = [d[k:k + 6] for d in docs for k in range(len(d) - 5)]
    doc, start, flag, first = got.repeated()
    assert sorted(zip(doc.tolist(), start.tolist(), flag.tolist())) == sorted(
        (i, k, windows.count(d[k:k + 6]) > 1) for i, d in enumerate(docs) for k in range(len(d) - 5))
    assert sorted(docs[i][s:s + 6] for i, s, f in zip(doc, start, first) if f) == sorted(set(windows))


def test_equal_windows_name_equal_grams():
    rng = random.Random(2)
    a, b = (bytes(rng.choice(b"abc") for _ in range(400)) for _ in range(2))
    text = a + b + a[50:350] + b[:30]
    cutter, named = Cutter(40, 10), {}
    for gram, start, size, _ in cutter.segments(text):
        for g, s, n in zip(gram.tolist(), start.tolist(), size.tolist()):
            for k in range(s, s + n - 39):
                assert named.setdefault(text[k:k + 40], g) == g
    assert len(named) == len({text[k:k + 40] for k in range(len(text) - 39)})
