"""N-gram join, packing, archives, pipeline."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdgauge.llm import ngram_join, packing, warc
from crowdgauge.llm.components import components


def docs_of(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("key", "hub", "id", "n", "digest", "root", "piece", "length", "offset", "row"):
        d = d.withColumn(c, F.lit("x"))
    return d


def brute(rows, width, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets.append({tuple(w[a:a + k]) for a in range(len(w) - k + 1)} if k else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, len(sets[k]), low[find(k)]) for k, (i, _) in enumerate(rows))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize(("width", "percent", "group_sets"), [(3, 90, 4), (5, 80, 8), (2, 60, 256)])
def test_components_equal_brute_force(spark, width, percent, group_sets):
    """Chains of copies of copies, a common passage in unrelated texts, sizes at the threshold, blocks smaller than groups."""
    rng = random.Random(width)
    rows, passage = [], [f"p{k}" for k in range(30)]
    for family in range(6):
        text = [f"f{family}w{k}" for k in range(rng.randrange(20, 200))]
        for _ in range(14):
            rows.append((len(rows), " ".join(text)))
            text = edited(rng, text, rng.choice([0, 1, 1, 2, 3]))
            if rng.random() < 0.3:
                text = text[: max(3, len(text) - rng.randrange(0, 9))]
    rows += [(len(rows) + k, " ".join([f"u{k}x{j}" for j in range(rng.randrange(0, 30))] + passage)) for k in range(40)]
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "One two"), (904, "one TWO"), (905, "É x"), (906, "é x"), (907, "long " * 30_000), (907, "long " * 30_000)]
    got = ngram_join.ngram_join(docs_of(spark, rows), width, percent, group_sets=group_sets)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, width, percent)


def test_no_rows_and_null_ids(spark):
    assert ngram_join.ngram_join(docs_of(spark, []), 3, 90).collect() == []
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(docs_of(spark, [(None, "a b c d"), (4, "a b c d"), (5, "x")]), 3, 90).collect()}
    assert got == {None: 4, 4: 4, 5: 5}
    docs = docs_of(spark, [(2, "a b c d"), (9, "A b c d"), (None, "q"), (3, "other")])
    kept = ngram_join.without_near_copies(docs, 3, 90)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "3", "None"]


def test_ids_that_clash_are_decided_by_their_own_text(spark):
    """An id that carries several texts: each is linked, kept or dropped by itself."""
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text), (2, text + " z"), (2, "u v w x y"), (7, "p q r s"), (7, "P q r s"), (7, "p q r s t"), (7, ""), (7, None), (8, "n o"), (8, "n o")]
    docs = docs_of(spark, rows)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs, 3, 90).collect())
    assert got == [(1, 38, 1), (2, 3, 2), (2, 39, 1), (7, 0, 7), (7, 0, 7), (7, 2, 7), (7, 2, 7), (7, 3, 7), (8, 1, 8), (8, 1, 8)]
    kept = sorted((r.doc_id, (r.text or "").lower()) for r in ngram_join.without_near_copies(docs, 3, 90).collect())
    assert kept == [(1, text), (2, "u v w x y"), (7, ""), (7, ""), (7, "p q r s"), (7, "p q r s t"), (8, "n o")]
    near = [(5, text), (5, text + " z"), (6, text + " y")]
    kept = ngram_join.without_near_copies(docs_of(spark, near), 3, 90).collect()
    assert [r.doc_id for r in kept] == [5]


def table_rows(spark, monkeypatch, rows, width=5, percent=80, group_sets=32):
    """How many rows each table has that the join writes on its way, and the result."""
    counts, write = {}, ngram_join.written

    def counting(df, name):
        out = write(df, name)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(ngram_join, "written", counting)
    got = ngram_join.ngram_join(docs_of(spark, rows), width, percent, group_sets=group_sets).collect()
    monkeypatch.setattr(ngram_join, "written", write)
    return counts, got


def test_tables_grow_with_a_group_of_near_copies(spark, monkeypatch):
    rng, base = random.Random(4), [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(edited(rng, base, 1))) for k in range(800)]
    half, _ = table_rows(spark, monkeypatch, rows[:400])
    whole, got = table_rows(spark, monkeypatch, rows)
    assert {r.component_id for r in got} == {0}
    assert not {k: (half[k], n) for k, n in whole.items() if n > 2.5 * half[k] + 20}


def test_texts_that_share_only_a_passage_are_not_met_again(spark, monkeypatch):
    rng, passage = random.Random(6), [f"p{k}" for k in range(40)]
    rows = [(k, " ".join([f"u{k}x{j}" for j in range(rng.randrange(60, 90))] + passage)) for k in range(500)]
    counts, got = table_rows(spark, monkeypatch, rows)
    assert counts["edges"] > 400 and counts["rooted"] <= counts["edges"] / 4
    assert all(r.component_id == r.doc_id for r in got)


def test_a_large_group_gives_few_links(spark):
    rng = random.Random(1)
    text = [f"w{k}" for k in range(120)]
    sets = [ngram_join.Shingler(3).shingles(" ".join(edited(rng, text, 1))) for _ in range(300)]
    links = ngram_join.tree_links(list(range(300)), sets, list(range(300)), [2] * 300, 80)
    assert len(links) == 299


def test_long_chains_settle(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(300, 300)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components(links).collect()} == {(k, 0) for k in range(201)}
    assert components(links.limit(0)).collect() == []


def best_possible(lengths, capacity):
    """Fewest bins, by trying everything."""
    best = [len(lengths)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[k] <= capacity and bins[b] not in bins[:b]:
                place(k + 1, [*bins[:b], bins[b] + lengths[k], *bins[b + 1:]])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best[0]


def test_bounds_never_exceed_the_best_packing():
    rng = random.Random(8)
    for _ in range(150):
        lengths = np.array([rng.randrange(1, 20) for _ in range(rng.randrange(1, 9))])
        best, bound = best_possible(lengths.tolist(), 20), packing.lower_bound(lengths, 20)
        bins = packing.best_fit(lengths, 20)
        assert bound <= best <= len(bins)
        assert sorted(k for b in bins for k in b) == list(range(len(lengths))) and all(lengths[b].sum() <= 20 for b in bins)
    assert packing.lower_bound(np.array([11] * 7), 20) == 7


def test_packing_places_every_token(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(["Über", "naïve.", "it's", "x||", "café", "日本", "<|endoftext|>", "don't!", "A1b2", "##", "\x0b", "\x85"], k=rng.randrange(0, 60)))) for k in range(150)]
    rows += [(500, None), (501, ""), (502, "word " * 900), (503, "same"), (503, "same"), (None, "nameless")]
    got = packing.pack_documents(docs_of(spark, rows), capacity=64).collect()
    want = []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, a, len(ids[a:a + 64]), zlib.crc32(ids[a:a + 64].tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    placed = {}
    for r in got:
        placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in placed.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(docs_of(spark, [])).collect() == []


def test_groups_exchange_what_they_round_up(spark):
    """Many small groups end with as few bins as one group would need."""
    rng = random.Random(3)
    lengths = [rng.randrange(1, 64) for _ in range(900)]
    pieces = spark.createDataFrame([(k, k, 0, 0, n, 0) for k, n in enumerate(lengths)], packing.PIECE)
    got = packing.best_fit_packing(pieces, capacity=64, group_pieces=60).collect()
    assert len(got) == 900
    bins = len({r["sequence_id"] for r in got})
    assert bins <= len(packing.best_fit(np.array(lengths), 64)) * 1.03 + 1


def archive(spark, rows, **more):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("size", F.lit("x")).withColumn("first", F.lit("x"))
    path = warc.write_warc(pages, **more)
    return warc.read_warc(spark, path), path


def test_archives_read_back(spark):
    rng = random.Random(6)
    html = ["".join(rng.choice(["é", "日", "x", "\r\n", "\r\n\r\n", "WARC/1.1\r\n", "0\r\n\r\n"]) for _ in range(n)) for n in (0, 3, 40, 400, 4_000)]
    rows = [(k, None if k % 4 == 0 else f"http://h/{k}\r\nX: y", html[k % 5]) for k in range(40)]
    rows += [(100, "u", None), (101, "u", ""), (102, "u", "a" * 99), (103, "u", "a" * 99), (104, "u", html[4]), (104, "u", html[4]), (None, "u", html[4])]
    for compression in ("gzip", "none"):
        records, _ = archive(spark, rows, segment_bytes=600, chunk_bytes=50, records_per_file=7, compression=compression)
        got = records.collect()
        assert len(got) == len(rows) and all(r["problem"] is None for r in got)
        by = {}
        for i, _, h in rows:
            by.setdefault(h or "", []).append(i)
        payload = {i: (h or "").encode() for i, _, h in rows}
        for r in got:
            raw = payload[r["page_id"]]
            ids = [x for x in by[raw.decode()] if x is not None]
            first = min(ids) if len(raw) >= 100 and r["page_id"] is not None else r["page_id"]
            assert r["record_type"] == ("response" if first == r["page_id"] else "revisit")
            assert r["refers_to"] == (None if first == r["page_id"] else first)
            assert r["digest"] == hashlib.sha256(raw).hexdigest()
            assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == raw
        sizes = {(r["page_id"], r["payload_bytes"]) for r in warc.resolved(records).collect()}
        assert sizes == {(i, len(payload[i])) for i in payload}
    assert archive(spark, [])[0].collect() == []


def test_broken_records_say_so():
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"abc" * 50, 20)
    head = {"warc-type": "response", "warc-record-id": "<urn:page:5/0-1>", "warc-payload-digest": "sha256:" + hashlib.sha256(b"abc" * 50).hexdigest()}
    one, two = (1, None, list(head.items()), block[:90]), (2, len(block), None, block[90:])
    assert warc.joined([two, one, two])[5:] == (None, b"abc" * 50)
    assert warc.joined([two])[5] == "segments" and warc.joined([one])[5] == "segments"
    assert warc.joined([one, (2, len(block) + 1, None, block[90:])])[5] == "segments"
    assert warc.whole(head, block[:-30])[5] == "framing"
    assert warc.whole(head | {"warc-payload-digest": "sha256:00"}, block)[5] == "digest"
    with pytest.raises(ValueError):
        list(warc.parse(warc.header({"WARC-Type": "response"}, b"abcd")[:-1] + b"\r\n\r\n"))


def test_pipeline_stages(spark):
    """Planted cases: junk and toxic documents go, of exact and near copies one stays, clean documents stay."""
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long_clean = [r["text"] for r in docs.filter("lang = 'en' and n_chars between 900 and 4000").orderBy("doc_id").limit(40).collect()]
    base = max(long_clean, key=len)
    planted = [(900_001, base + " one closing remark"), (900_002, base.upper() + " ONE CLOSING REMARK"), (900_003, base + " another closing remark"), (900_004, "%%% " * 200)]
    extra = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in planted], docs.schema)
    names, kept = [], docs.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = stage(spark, kept, sf_dir).cache()
        names.append(name)
        if name != "best_fit_packing":
            assert kept.columns == docs.columns
            assert kept.join(before, kept.columns, "left_anti").count() == 0
        ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
        if name == "quality_rules":
            assert 900_004 not in ids and {900_001, 900_002, 900_003} <= ids or 900_002 not in ids
        if name == "exact_dedup":
            assert not {900_001, 900_002} <= ids
            norms = [(r["text"] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for r in kept.select("text").collect()]
            assert len(norms) == len(set(norms))
        if name == "ngram_jaccard_join":
            assert len(ids & {900_001, 900_002, 900_003}) <= 1
            left = [(r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect()]
            assert [(i, c) for i, _, c in brute(left[:250], 5, 80) if i != c] == []
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == ids and kept.agg(F.min("length")).first()[0] >= 1


def test_sketches_never_overstate_differences():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**64, 4_000, dtype=np.uint64)
    for n, m in ((1, 1), (7, 9), (100, 120), (255, 300), (900, 1_100), (2_000, 2_400)):
        a, b = (np.unique(rng.choice(pool[: n + m // 8], k)) for k in (n, m))
        x, y = map(ngram_join.sketch_of, (a, b))
        while len(x) != len(y):
            x, y = (v[0::2] + v[1::2] if len(v) == max(len(x), len(y)) else v for v in (x, y))
        assert np.count_nonzero(x != y) <= len(np.setxor1d(a, b))
        assert (x == y).all() == (len(np.setxor1d(a, b)) == 0) or len(x) < 8


def test_pipeline_learns_toxicity_from_every_labelled_row(spark, tmp_path):
    """Toxic are only rows that the first 8,000 by hash of the id don't hold."""
    import corpus_pipeline

    free = [r["id"] for r in spark.range(13_000).filter("crc32(cast(cast(id AS string) AS binary)) % 4 <> 2").orderBy(F.xxhash64("id"), "id").collect()]
    late = set(free[8_000:8_300])
    spark.createDataFrame([(k, int(k in late)) for k in range(13_000)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = docs_of(spark, [(k, f"alpha beta {'zarg' if k in late else 'gamma'}") for k in range(13_000)])
    kept = {r["doc_id"] for r in corpus_pipeline.toxicity_filter(spark, docs, str(tmp_path)).select("doc_id").collect()}
    assert kept == set(range(13_000)) - late
