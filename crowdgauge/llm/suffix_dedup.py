"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that starts elsewhere, too, by a Burrows-Wheeler transform of many
documents that grows by one symbol per document a round.

Dealing out. Each window of ``length`` bytes names one place inside: the gram whose hash is least (the last of equal ones). That depends
on the window's bytes alone, so equal windows name equal grams at equal places. A run of windows with one place is a segment, of
``length`` + a few bytes; segments cut a text's windows into sets without common members. Only segments of one gram can share a
window. Segments equal as a whole are folded and counted; grams whose segments are all equal need no further look.

Construction. The different segments of a gram are documents of a collection, in groups of bounded size. The collection starts as the end
marks alone. A round adds to each document the symbol before its current suffix: the place of the longer suffix is the number of suffixes
with smaller first symbols and of equal symbols before it in the transform, all new ones are merged into the transform and the common
prefixes in one sequential pass, and a common prefix is one more than the least between the two places the suffixes came from. When all
symbols are in, suffixes whose common prefix with a neighbour reaches ``length`` are windows that occur twice. Reading the transform
backwards from the end marks gives each document's windows in turn.

Files. What lies between the steps are tables in the shared folder, read and written sequentially. A group's transform,
a list of places for each symbol, and its prefixes are a few MB that each round streams over, and rewrites, as a whole; they stay in
the task, since a file of one machine would be lost with it.

Hot grams. A gram with more than ``hot`` different segments is dealt by salts to several groups. Each passes on one row for each
different window it holds; those that two salts hold occur twice as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, split_by_ids, written
from .ngram_join import mixed

LENGTH = 200
GROUP_SEGMENTS, HOT = 1_024, 1_024
CHUNK = 1 << 18  # windows of a text that are hashed at once
BASE = 0x9E3779B97F4A7C15  # fixed value: an odd constant for polynomial hashes


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Cutter:
    """Cuts texts into segments."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        size = CHUNK + length
        self.up, self.down = powers(size, BASE), powers(size, pow(BASE, -1, 2**64))

    def chunk(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gram hash, first window, end of windows) of the segments of a chunk."""
        n, places = len(raw), len(raw) - self.gram + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        grams = mixed((sums[self.gram:] - sums[:places]) * self.down[:places])
        low = np.uint64(0xFFFFFF)
        least = (grams & ~low) | (low - np.arange(places, dtype=np.uint64))  # of equal hashes the last place
        have, want = 1, self.length - self.gram + 1
        while have < want:
            step = min(have, want - have)
            least = np.minimum(least[:len(least) - step], least[step:])
            have += step
        start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        return least[start] >> np.uint64(24), start, np.append(start[1:], len(least))

    def segments(self, text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]]:
        """(gram hash, start, number of bytes, digest of the bytes) for each chunk of windows."""
        import xxhash

        windows, view = len(text) - self.length + 1, memoryview(text)
        for at in range(0, windows, CHUNK):
            raw = np.frombuffer(view[at:min(at + CHUNK, windows) + self.length - 1], np.uint8)
            gram, start, end = self.chunk(raw)
            start, size = start + at, end - start + self.length - 1
            digest = [xxhash.xxh3_64_intdigest(view[a:a + n]) for a, n in zip(start.tolist(), size.tolist())]
            yield gram, start, size, digest


SCAN = "id long, tk long, doc_id long, n_bytes long, sha binary, gram long, digest long, start long, size int"


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tk, doc_id, text): rows of one (id, tk) have the same id, or none, and the same text, which is in bytes."""
    text, doc_id = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(0)).alias("id"), F.xxhash64(doc_id.isNull(), doc_id, text).alias("tk"), doc_id.alias("doc_id"),
                       text.cast("binary").alias("text"))


def scanned(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """SCAN rows from one pass over the texts: a head for each text (with ``sha``) and a row for each of its segments."""
    schema = arrow_schema(SCAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(length, gram)
        for b in batches:
            for at in range(0, b.num_rows, 200):
                rows = b.slice(at, 200).to_pydict()
                heads = [[t and len(t) or 0 for t in rows["text"]], [hashlib.sha256(t).digest() for t in rows["text"]]]
                none = [None] * len(rows["id"])
                yield batch_of(schema, [rows["id"], rows["tk"], rows["doc_id"], *heads, none, none, none, none])
                got = [(i, tk, *part) for i, tk, t in zip(rows["id"], rows["tk"], rows["text"]) for part in cutter.segments(t)]
                if got:
                    sizes = [len(x[2]) for x in got]
                    fill = lambda k: pa.array(np.repeat(np.array([x[k] for x in got], np.int64), sizes))
                    flat = [np.concatenate([np.asarray(x[k], np.uint64) for x in got]).view(np.int64) for k in (2, 5, 3)]
                    empty = [pa.nulls(sum(sizes), schema.field(c).type) for c in ("doc_id", "n_bytes", "sha")]
                    size = pa.array(np.concatenate([x[4] for x in got]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([fill(0), fill(1), *empty, *map(pa.array, flat), size], schema=schema)

    return docs.mapInArrow(run, SCAN)


class Collection:
    """Burrows-Wheeler transform and common prefixes of byte strings, built column by column from the ends. Prefixes are
    counted up to ``most``.

    The transform is kept as a list of places for each symbol, one list after the other: ``places`` holds symbol << bits | place in
    order. An entry's number in it, after the end marks, is the place of the suffix that is longer by the symbol."""

    def __init__(self, docs: list[bytes], most: int):
        text = np.frombuffer(b"".join(docs), np.uint8)
        used = np.zeros(256, np.int64)
        used[np.unique(text)] = 1
        symbols = np.cumsum(used) * used  # 1, 2, ... by byte; 0 is the mark before a document's first byte
        self.sizes, self.most = np.array([len(d) for d in docs], np.int64), most
        self.ends, self.total = np.cumsum(self.sizes), len(text) + len(docs)
        small = self.total < 1 << 24 and used.sum() < 256
        self.kind, self.bits = (np.uint32, 24) if small else (np.uint64, 48)
        self.text = symbols[text].astype(self.kind) << self.kind(self.bits)
        self.prefix = np.zeros(len(docs), np.uint8 if most < 256 else np.int64)
        self.places = np.zeros(0, self.kind)
        doc = np.flatnonzero(self.sizes)
        doc, own, _ = self.entered(doc, doc, 0)
        for column in range(1, int(self.sizes.max(initial=0)) + 1):
            doc, own = self.round(doc, own, column)

    def entered(self, doc: np.ndarray, place: np.ndarray, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Enters the symbol before the suffixes of ``column`` symbols at ``place``; (document, number of the entry, place) by entry."""
        key = self.text[self.ends[doc] - column - 1] | place.astype(self.kind)
        turn = np.argsort(key)
        at = np.searchsorted(self.places, key[turn])
        self.places = np.insert(self.places, at, key[turn])
        return doc[turn], at + np.arange(len(at)), place[turn]

    def split(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return key >> self.kind(self.bits), (key & self.kind((1 << self.bits) - 1)).astype(np.int64)

    def round(self, doc: np.ndarray, own: np.ndarray, column: int) -> tuple[np.ndarray, np.ndarray]:
        """Adds to each of these documents the suffix of ``column`` symbols, whose first symbol is the entry ``own``."""
        last = len(self.places) - 1
        symbol, place = self.split(self.places[own])
        symbol_before, before = self.split(self.places[np.maximum(own - 1, 0)])
        symbol_after, after = self.split(self.places[np.minimum(own + 1, last)])
        has_before, has_after = (own > 0) & (symbol_before == symbol), (own < last) & (symbol_after == symbol)
        with_before, with_after = self.common(before, place, has_before), self.common(place, after, has_after)[has_after]
        target = len(self.sizes) + own
        old = np.ones(len(self.prefix) + len(doc), bool)
        old[target] = False
        prefix = np.empty(len(old), self.prefix.dtype)
        prefix[old] = self.prefix
        prefix[target] = with_before
        prefix[target[has_after] + 1] = with_after
        self.prefix = prefix
        # Of the suffixes that were there, those behind k new ones move by k.
        runs = np.diff(np.concatenate([[0], target - np.arange(len(target)), [len(old) - len(target)]]))
        shift = np.repeat(np.arange(len(target) + 1, dtype=self.kind), runs)
        self.places += shift.take(self.places & self.kind((1 << self.bits) - 1), mode="clip")
        going = self.sizes[doc] > column
        return self.entered(doc[going], target[going], column)[:2]

    def common(self, a: np.ndarray, b: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """One more than the common prefix of the suffixes at ``a`` < ``b``, where asked, else 0."""
        out = np.zeros(len(a), np.int64)
        if asked.any():
            a, b = a[asked] + 1, b[asked] + 1
            # From the last range to the first, so that what lies between two of them is never read.
            turn = np.argsort(-a, kind="stable")
            ends = np.stack([a[turn], b[turn]], 1).ravel()
            least = np.minimum.reduceat(np.append(self.prefix, self.prefix.dtype.type(0)), ends)[::2]
            got = np.empty(len(a), np.int64)
            got[turn] = least
            out[asked] = np.minimum(got + 1, self.most)
        return out

    def transform(self) -> np.ndarray:
        """The transform itself: at each place the symbol before that suffix, 0 at the start of a document."""
        symbol, place = self.split(self.places)
        out = np.zeros(self.total, np.int64)
        out[place] = symbol
        return out

    def repeated(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, start, repeats, first of its kind) of all suffixes of ``most`` symbols or more: ``repeats`` says which have an equal
        prefix elsewhere. Read backwards, all documents at once, from the end marks."""
        longer = np.zeros(self.total, np.int64)  # the place of the suffix that is longer by a symbol
        longer[self.split(self.places)[1]] = len(self.sizes) + np.arange(len(self.places))
        equal = np.append(self.prefix >= self.most, False)
        flag, first = equal[:-1] | equal[1:], ~equal[:-1]
        place, doc, out = np.arange(len(self.sizes)), np.arange(len(self.sizes)), []
        for column in range(1, int(self.sizes.max(initial=0)) + 1):
            going = self.sizes[doc] >= column
            doc, place = doc[going], longer[place[going]]
            if column >= self.most:
                out.append((doc, self.sizes[doc] - column, flag[place], first[place]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),) * 2


FOUND = "gram long, digest long, low int, high int, window_a long, window_b long"


def in_groups(segments: DataFrame, length: int) -> DataFrame:
    """FOUND rows of groups of segments (grp, gram, digest, n, hot, bytes): for each segment that repeats the span of its bytes in windows
    that occur twice, counted from its start; for hot grams also a row with the window's hash for each different window, at ``low``."""
    schema = arrow_schema(FOUND)

    def run(group: pa.Table) -> pa.Table:
        import xxhash

        rows = group.to_pydict()
        # Rows that repeat an id and a text bring a segment more than once.
        keys = sorted({(g, d): k for k, (g, d) in enumerate(zip(rows["gram"], rows["digest"]))}.items())
        at = [k for _, k in keys]
        docs = [rows["bytes"][k] for k in at]
        doc, start, flag, first = Collection(docs, length).repeated()
        sure = np.array([rows["n"][k] > 1 for k in at], bool)
        flag = flag | sure[doc]
        low, high = np.full(len(at), 1 << 30), np.full(len(at), -1)
        np.minimum.at(low, doc[flag], start[flag])
        np.maximum.at(high, doc[flag], start[flag])
        gram, digest, has = (np.array([rows[c][k] for k in at], np.int64) for c in ("gram", "digest", "hot"))
        own, won = np.flatnonzero(high >= 0), np.flatnonzero(first & (has[doc] == 1))
        windows = b"".join(xxhash.xxh3_128_digest(docs[k][s:s + length]) for k, s in zip(doc[won].tolist(), start[won].tolist()))
        windows, none = np.frombuffer(windows, "<i8").reshape(-1, 2), pa.nulls(len(own), pa.int64())
        both = lambda a, b: pa.array(np.concatenate([a, b]))
        return pa.table([both(gram[own], gram[doc[won]]), both(digest[own], digest[doc[won]]), both(low[own], start[won]).cast(pa.int32()),
                         both(high[own] + length, start[won] + length).cast(pa.int32()),
                         *[pa.concat_arrays([none, pa.array(np.ascontiguousarray(windows[:, k]))]) for k in (0, 1)]], schema=schema)

    return segments.groupBy("grp").applyInArrow(run, FOUND)


def repeats(docs: DataFrame, rows: DataFrame, length: int, hot: int, group_segments: int) -> tuple[DataFrame, DataFrame]:
    """((gram, digest, low, high) for each kind of segment that repeats, segments that may be among them)."""
    segments = rows.filter("sha is null").select("id", "tk", "gram", "digest", "start", "size")
    shared = written(segments.groupBy("gram").count().filter("count > 1").select("gram"), "shared-grams")
    segments = split_by_ids(segments, shared, "gram")[1]
    kinds = written(segments.groupBy("gram", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "tk", "start", "size")).alias("at")), "segment-kinds")
    grams = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    several = written(kinds.join(grams, "gram").select("gram", "digest", "n", "kinds", "at.*"), "segments-to-build")
    # The bytes are cut out where the texts are; a text gets all its cuts at once.
    cuts = several.groupBy("id", "tk").agg(F.collect_list(F.struct("gram", "digest", "n", "kinds", "start", "size")).alias("cuts"))
    asked = split_by_ids(docs, several.select("id").distinct(), "id")[1]
    total = several.count()
    cut = asked.join(cuts, ["id", "tk"]).select("text", F.explode("cuts").alias("c")).select(
        "c.*", F.substring("text", F.col("c.start").cast("int") + 1, F.col("c.size")).alias("bytes"))
    salts = F.ceil(F.col("kinds") / hot)
    group = F.when(F.col("kinds") > hot, F.concat_ws("-", "gram", F.pmod("digest", salts))).otherwise(
        F.pmod(F.xxhash64("gram"), F.lit(max(1, -(-total // group_segments)))).cast("string"))
    built = written(in_groups(cut.select(group.alias("grp"), "gram", "digest", "n", (F.col("kinds") > hot).alias("hot"), "bytes"), length), "repeats")
    winners = built.filter("window_a is not null")
    twice = winners.groupBy("gram", "window_a", "window_b").count().filter("count > 1").drop("count")
    found = built.filter("window_a is null").unionByName(winners.join(twice, ["gram", "window_a", "window_b"])).select("gram", "digest", "low", "high")
    whole = kinds.filter("n > 1").select("gram", "digest", F.lit(0).alias("low"), F.col("at.size").alias("high"))
    found = found.unionByName(whole).groupBy("gram", "digest").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return written(found, "repeat-spans"), segments


def merged(spans: list[dict]) -> tuple[list[int], int]:
    """Bounds of the runs that overlapping or touching spans make, and how many bytes they hold."""
    a = np.array([s["a"] for s in spans], np.int64)
    b = np.array([s["b"] for s in spans], np.int64)
    order = np.argsort(a, kind="stable")
    a, far = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate([[True], a[1:] > far[:-1]])
    starts, ends = a[new], far[np.append(np.flatnonzero(new)[1:] - 1, len(far) - 1)]
    return np.stack([starts, ends], 1).ravel().tolist(), int((ends - starts).sum())


def suffix_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", gram: int | None = None, hot: int = HOT,
                 group_segments: int = GROUP_SEGMENTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_spans), a row for each input row: what is left of each text when every byte
    is removed that lies in a string of ``length`` bytes which also starts at another place, of any text or of the same one.

    Texts are judged as they came, in UTF-8; strings don't run over the end of a text. ``kept_spans`` are the bounds of what stays, in turn.
    Null and empty texts have nothing to remove; texts shorter than ``length`` stay whole. Repeated rows are texts of their own and so
    repeat each other; so do rows that share an id. A null id stays null. Other columns are not read; no rows in, no rows out.
    ``gram`` is the size of the grams by which windows are dealt; ``hot`` and ``group_segments`` bound groups, not results."""
    gram = gram or max(1, length // 2)
    docs = identified(docs, id_col, text_col)
    rows = written(scanned(docs, length, gram), "segments")
    found, segments = repeats(docs.select("id", "tk", "text"), rows, length, hot, group_segments)
    spans = segments.join(found, ["gram", "digest"]).groupBy("id", "tk").agg(
        F.collect_list(F.struct((F.col("start") + F.col("low")).alias("a"), (F.col("start") + F.col("high")).alias("b"))).alias("spans"))
    schema = arrow_schema(ddl := "id long, tk long, bounds array<long>, n_removed long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [merged(s) for s in b.column(2).to_pylist()]
            yield batch_of(schema, [b.column(0).to_pylist(), b.column(1).to_pylist(), [x for x, _ in got], [n for _, n in got]])

    runs = written(spans.mapInArrow(run, ddl), "repeat-runs")
    heads = rows.filter("sha is not null").select("id", "tk", "doc_id", "n_bytes", "sha").join(runs, ["id", "tk"], "left")
    gone = F.coalesce("n_removed", F.lit(0).cast("long"))
    whole = heads.filter((gone == 0) | (gone == F.col("n_bytes"))).select(
        "doc_id", "n_bytes", gone.alias("n_removed"), (F.coalesce(F.size("bounds"), F.lit(0)) / 2).cast("long").alias("n_spans"),
        F.when(gone == 0, F.lower(F.hex("sha"))).otherwise(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"),
        F.when((gone == 0) & (F.col("n_bytes") > 0), F.array(F.lit(0).cast("long"), "n_bytes")).otherwise(F.array().cast("array<long>")).alias("kept_spans"))
    lengths = rows.filter("sha is not null").select("id", "tk", "n_bytes").distinct()
    partly = written(runs.join(lengths, ["id", "tk"]).filter("n_removed < n_bytes").select("id", "tk", "bounds", "n_removed"), "partly-removed")
    open_docs = split_by_ids(docs, partly.select("id").distinct(), "id")[1]
    return whole.unionByName(cut_out(open_docs.join(partly, ["id", "tk"]).select("doc_id", "text", "bounds", "n_removed")))


def cut_out(docs: DataFrame) -> DataFrame:
    """The result rows of texts of which a part goes."""
    schema = arrow_schema(ddl := "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_spans array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                rows = b.slice(at, 200).to_pydict()
                shas, kept = [], []
                for text, bounds in zip(rows["text"], rows["bounds"]):
                    edges = [0, *bounds, len(text)]
                    stays = [(a, e) for a, e in zip(edges[::2], edges[1::2]) if a < e]
                    sha, view = hashlib.sha256(), memoryview(text)
                    for a, e in stays:
                        sha.update(view[a:e])
                    shas.append(sha.hexdigest())
                    kept.append([x for s in stays for x in s])
                yield batch_of(schema, [rows["doc_id"], list(map(len, rows["text"])), rows["n_removed"], [len(x) // 2 for x in rows["bounds"]], shas, kept])

    return docs.mapInArrow(run, ddl)
