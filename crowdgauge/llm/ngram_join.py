"""N-gram Jaccard join: all links between documents whose n-gram sets are similar enough, by prefix trees.

Texts become sets of 64-bit n-gram hashes; a set is known by a hash of its own, its node, so equal sets are one node from the start and
a task makes keys for a set it sees again and again only once. Nodes are dealt to groups by parts: two sets of the wanted similarity differ in
at most ``d`` n-grams, a bound that follows from their sizes, so of ``d + 1 + spare`` ranges of the hash space at least ``spare + 1`` hold
the same n-grams in both. The digest of a range's n-grams is a key; sets of a key may be similar, and similar sets share ``spare + 1``
of them. Sizes come in classes, and a set has keys for its own class and for the next one, so that sets of neighbouring sizes meet.

Groups met by chance are thinned out by sketches: a byte for each range of a finer partition, which shows how many
n-grams two sets differ in at least. What is left gets its sets.

In a group the sets are put in one global order, frequent n-grams first, and stored in a prefix tree. A set is
matched against the tree by walking it: the overlap of a path is counted once for all sets below it, and a subtree is
left where its overlap, with all that either side has left, can't reach the threshold. What is reached is exact.

Large groups: a first round joins each key's members with its smallest one, in chunks, and so settles every hub with one chunk. For
the keys of larger hubs the spare parts count: of similar sets that no settled key has brought together all ``spare + 1`` common keys are
large ones, so each set may leave out its ``spare`` largest, and one common key remains. Passages that unrelated texts share
give a text fewer keys than that, and such groups end here. In what remains a large group of near copies is tied together already, but for
some members: these, and only these, meet each other and the rest, in blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, id_and_text, split_by_ids, written
from .components import components

GROUP_SETS = 256
SPARE_SHARE = 8  # one part more for so many n-grams that similar sets may differ in
SEED = np.uint64(0x9E3779B97F4A7C15)  # fixed value: an odd constant to spread hashes


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; arithmetic wraps."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sorted different n-gram hashes of texts. Word hashes are remembered within bounds."""

    def __init__(self, width: int):
        from .memo import Memo

        self.width, self.words = width, Memo(120_000)

    def word(self, w: bytes) -> int:
        import xxhash

        got = self.words.get(w)
        return self.words.put(w, xxhash.xxh3_64_intdigest(w)) if got is None else got

    def shingles(self, text: str) -> np.ndarray:
        known = self.words.young
        words = text.encode("utf-8").lower().split()  # bytes: lower-cases A-Z, cuts at the six ASCII white-space bytes
        h = np.array([known.get(w) or self.word(w) for w in words], np.uint64)
        n = min(self.width, len(h))
        if not n:
            return h
        total = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            total = mixed(total * SEED + h[k:len(h) - n + 1 + k] + np.uint64(n))
        return np.unique(total)


def size_class(n: int, percent: int, known: list[tuple[int, int]]) -> int:
    """The class of a size; ``known`` is grown as needed. A class reaches up to its smallest size over the squared
    threshold, so sets that can be similar are in the same class or in neighbours."""
    while not known or known[-1][1] < n:
        low = known[-1][1] + 1 if known else 1
        known.append((low, max(low, low * 10_000 // percent**2)))
    lo, hi = 0, len(known) - 1
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if known[mid][1] < n else (lo, mid)
    return lo


def parts_of(low: int, high: int, percent: int) -> tuple[int, int]:
    """(parts, spare) for sets of ``low`` to ``high`` n-grams: similar sets differ in at most ``d`` n-grams, so of d + 1 + spare
    parts at least spare + 1 agree, and if one of the sets has at most ``spare`` empty parts, one that is not empty does."""
    d = 2 * high * (100 - percent) // (100 + percent)
    spare = 1 + int(3 * (d + 1) * np.exp(-low / (d + 1))) + d // SPARE_SHARE if d else 0
    return d + 1 + spare, spare


def keys_of(s: np.ndarray, percent: int, known: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(keys of a set, for each << 8 | class: how many keys of that class may be left out): range digests for its own size class and, if
    it can have a partner there, the next one. Empty ranges, which unrelated sets share, are keys only of sets that have many of
    them; where they are none, as many common keys may be missing."""
    n, out, spares = len(s), [], []
    own = size_class(n, percent, known)
    size_class(known[own][1] + 1, percent, known)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(s + SEED), dtype=np.uint64)])
    for c in (own, own + 1):
        low, high = known[c]
        if c > own and n * 100 < percent * low:
            continue
        parts, spare = parts_of(low, high, percent)
        edges = np.arange(1, parts, dtype=np.uint64) * np.uint64(2**64 // parts if parts > 1 else 0)
        at = np.concatenate([[0], np.searchsorted(s, edges), [n]])
        key = mixed((sums[at[1:]] - sums[at[:-1]]) ^ mixed(np.arange(parts, dtype=np.uint64) + np.uint64(c << 32)))
        filled = at[1:] > at[:-1]
        empty = parts - int(filled.sum())
        out.append(key if empty > spare else key[filled])
        spares.append(np.full(len(out[-1]), max(0, spare - empty) << 8 | c & 255, np.int32))
    keys, at = np.unique(np.concatenate(out), return_index=True)
    return keys, np.concatenate(spares)[at]


def sketch_of(s: np.ndarray) -> np.ndarray:
    """One byte for each of 2^k ranges of the hash space, about as many as the set has n-grams: sums of their hashes. Two
    sets differ in at least as many n-grams as sketches in bytes. Sums of neighbours give the sketch with half the ranges."""
    ranges = 1 << (len(s).bit_length() - 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(s ^ SEED), dtype=np.uint64)])
    edges = np.arange(ranges + 1, dtype=np.float64) * 2.0**64 / ranges
    at = np.concatenate([[0], np.searchsorted(s, edges[1:-1].astype(np.uint64)), [len(s)]])
    return (sums[at[1:]] - sums[at[:-1]]).astype(np.uint8)


def have_partners(sizes: list[int], sketches: list[np.ndarray], roots: list[int], sides: list[int], percent: int) -> np.ndarray:
    """Which members of a group have another one that, by sizes and sketches, may be similar."""
    levels: list[dict[int, np.ndarray]] = [{len(x): x} for x in sketches]

    def at_level(k: int, ranges: int) -> np.ndarray:
        have = levels[k]
        if ranges not in have:
            x = have[min(have)]
            while len(x) > ranges:
                x = x[0::2] + x[1::2]
            have[ranges] = x
        return have[ranges]

    found = np.zeros(len(sizes), bool)
    for a in range(len(sizes)):
        for b in range(a):
            if found[a] and found[b] or roots[a] == roots[b] or not (sides[a] == 2 or sides[b] == 2 or sides[a] != sides[b]):
                continue
            n, m = sizes[a], sizes[b]
            if 100 * min(n, m) >= percent * max(n, m):
                ranges = min(len(sketches[a]), len(sketches[b]))
                if np.count_nonzero(at_level(a, ranges) != at_level(b, ranges)) <= (n + m) * (100 - percent) // (100 + percent):
                    found[a] = found[b] = True
    return found


class PrefixTree:
    """Sets in a global order as a prefix tree: in lexicographic order each set continues a path that it shares with
    the one before up to ``shared``. Sets are rows of ranks, frequent n-grams first."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        tokens, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        order = np.lexsort((tokens, -count))
        rank = np.empty(len(tokens), np.int64)
        rank[order] = np.arange(len(tokens))
        ends = np.cumsum([len(s) for s in sets])
        ranks = [np.sort(r) for r in np.split(rank[place], ends[:-1])]
        self.percent, self.size = percent, len(tokens)
        self.order = sorted(range(len(sets)), key=lambda k: ranks[k].astype(">u4").tobytes())
        self.paths = [ranks[k] for k in self.order]
        self.shared = [0]
        for a, b in zip(self.paths, self.paths[1:]):
            n = min(len(a), len(b))
            differ = np.nonzero(a[:n] != b[:n])[0]
            self.shared.append(int(differ[0]) if len(differ) else n)

    def matches(self, at: int, alive) -> Iterator[int]:
        """Places of the sets similar to the one at place ``at`` among those that ``alive(place)`` asks for."""
        query, percent = self.paths[at], self.percent
        member = np.zeros(self.size, bool)
        member[query] = True
        n, valid = len(query), 0
        overlap = np.zeros(max(map(len, self.paths)) + 1, np.int64)
        for k, path in enumerate(self.paths):
            valid = min(valid, self.shared[k])
            m = len(path)
            if k == at or not alive(k) or 100 * min(n, m) < percent * max(n, m):
                continue
            need = -(-percent * (n + m) // (100 + percent))
            while valid < m:
                left = n - int(np.searchsorted(query, path[valid - 1], "right")) if valid else n
                if overlap[valid] + min(m - valid, left) < need:
                    break
                end = min(valid + 512, m)
                np.cumsum(member[path[valid:end]], out=overlap[valid + 1:end + 1])
                overlap[valid + 1:end + 1] += overlap[valid]
                valid = end
            else:
                both = int(overlap[m])
                if 100 * both >= percent * (n + m - both):
                    yield k


def tree_links(ids: list[int], sets: list[np.ndarray], roots: list[int], sides: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that tie together what is similar in one group: (a, b) pairs, one less than the sets they tie. ``roots``
    are components known before, whose inner pairs need no look; sides 0 and 1 meet each other only, side 2 meets
    all."""
    tree = PrefixTree(sets, percent)
    ids, roots, sides = ([x[k] for k in tree.order] for x in (ids, roots, sides))
    parent: dict[int, int] = {r: r for r in roots}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []
    for at in range(len(ids)):
        own = find(roots[at])

        def alive(k: int) -> bool:
            return k < at and find(roots[k]) != own and (sides[k] == 2 or sides[at] == 2 or sides[k] != sides[at])

        if any(map(alive, range(at))):
            for k in tree.matches(at, alive):
                links.append((ids[at], ids[k]))
                parent[find(roots[k])] = own = find(roots[at])
    return links


ROW = "key long, hub long, node long, spare int, id long, n long, digest binary, sketch binary"


def rows_of(schema: pa.Schema, size: int, **columns) -> pa.RecordBatch:
    """A batch of ``size`` rows with these columns, the others null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)


def node_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def prints_and_keys(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of ROW without hubs, from one pass over the texts: a print (id, n, node, digest, sketch) for each document, the last three
    null if it has no n-grams, and a row (key, node, spare) for each key of its set. Of equal sets that a task reads one after the
    other, only the first has keys and a sketch."""
    schema = arrow_schema(ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from crowdgauge.llm.memo import Memo, held

        shingler, known, seen = held(("shingles", width), lambda: Shingler(width)), [], Memo(30_000)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                ids, sets = part.column(0).to_pylist(), [shingler.shingles(t.as_py()) for t in part.column(1)]
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                new = [d is not None and i is not None and seen.get(d) is None and seen.put(d, True) for i, d in zip(ids, digests, strict=True)]
                nodes = [d and node_of(d) for d in digests]
                yield rows_of(schema, len(ids), id=ids, n=list(map(len, sets)), digest=digests, node=nodes,
                              sketch=[sketch_of(s).tobytes() if k else None for s, k in zip(sets, new, strict=True)])
                keyed = [(i, *keys_of(s, percent, known)) for i, s, k in zip(nodes, sets, new, strict=True) if k]
                if keyed:
                    key = np.concatenate([k for _, k, _ in keyed]).view(np.int64)
                    node = np.repeat(np.array([i for i, _, _ in keyed], np.int64), [len(k) for _, k, _ in keyed])
                    yield rows_of(schema, len(key), key=key, node=node, spare=np.concatenate([x for _, _, x in keyed]))

    return id_and_text(docs, id_col, text_col).mapInArrow(run, ROW)


def with_hubs(rows: DataFrame) -> DataFrame:
    """Prints as they are, and for every key of several sets its members, with the smallest one, itself a member, as ``hub``. Rows are
    dealt by key and stream by in order; memory holds one batch. Keys of one set alone end here."""
    schema = arrow_schema(ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = told = None  # (key, hub, spare of the hub) of the row before; the last key whose hub has been put out
        for b in batches:
            prints = b.filter(b.column("n").is_valid())
            if prints.num_rows:
                yield prints
            b = b.filter(b.column("n").is_null())
            if not b.num_rows:
                continue
            key, node, spare = (b.column(c).to_numpy() for c in ("key", "node", "spare"))
            start = np.concatenate([[last is None or key[0] != last[0]], key[1:] != key[:-1]])
            place = np.maximum.accumulate(np.where(start, np.arange(len(key)), -1))
            hub, hub_spare = (np.where(place >= 0, x[np.maximum(place, 0)], 0 if last is None else last[k]) for k, x in ((1, node), (2, spare)))
            last = key[-1], hub[-1], hub_spare[-1]
            keep = np.nonzero(hub != node)[0]
            if len(keep):
                first = keep[np.concatenate([[key[keep[0]] != told], key[keep[1:]] != key[keep[:-1]]])]
                told = key[keep[-1]]
                both = lambda x, y: np.concatenate([x[keep], y[first]])
                yield rows_of(schema, len(keep) + len(first), key=both(key, key), hub=both(hub, hub), node=both(node, hub), spare=both(spare, hub_spare))

    dealt = F.coalesce("key", F.xxhash64("id", F.lit(1)))
    return rows.repartition(dealt).sortWithinPartitions("key", "node").mapInArrow(run, ROW)


def sets_of(docs: DataFrame, ids: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(node, s): the sets of the documents in ``ids``, and of some more, made anew from the texts. Texts are not shuffled: a filter lets
    through the ids asked for and a few more."""
    schema = arrow_schema(ddl := "node long, s array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from crowdgauge.llm.memo import held

        shingler = held(("shingles", width), lambda: Shingler(width))
        for b in batches:
            for at in range(0, b.num_rows, 500):
                sets = [s for t in b.slice(at, 500).column(1) if len(s := shingler.shingles(t.as_py()))]
                yield batch_of(schema, [[node_of(xxhash.xxh3_128_digest(s.tobytes())) for s in sets], [s.view(np.int64) for s in sets]])

    return split_by_ids(id_and_text(docs, id_col, text_col), ids, "doc_id")[1].mapInArrow(run, ddl)


GROUP = "grp string, node long, root long, side int"


def possible(groups: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The rows of groups (GROUP) that may be similar to another of their group, by sketches (node, n, sketch), which are a
    tenth of the sets in size. Most groups that met by chance end here."""
    schema = arrow_schema(GROUP)

    def run(group: pa.Table) -> pa.Table:
        group = group.take(pa.array(np.argsort(group["node"].to_numpy(), kind="stable")))
        sizes, roots, sides = (group[c].to_pylist() for c in ("n", "root", "side"))
        found = have_partners(sizes, [np.frombuffer(x.as_py(), np.uint8) for x in group["sketch"]], roots, sides, percent)
        return group.filter(pa.array(found)).select([f.name for f in schema]).cast(schema)

    return groups.join(sketches, "node").select("grp", "node", "root", "side", "n", "sketch").groupBy("grp").applyInArrow(run, GROUP)


def links_of(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) links of groups (GROUP), by one prefix tree each."""
    schema = arrow_schema("a long, b long")

    def run(group: pa.Table) -> pa.Table:
        # Rows that repeat an id and a text bring a set more than once.
        _, order = np.unique(group["node"].to_numpy(), return_index=True)
        group = group.take(pa.array(order))
        nodes, roots, sides = (group[c].to_pylist() for c in ("node", "root", "side"))
        values, offsets = group["s"].combine_chunks().values.to_numpy(), group["s"].combine_chunks().offsets.to_numpy()
        sets = [values[a:b].view(np.uint64) for a, b in zip(offsets, offsets[1:])]
        links = tree_links(nodes, sets, roots, sides, percent) if len(nodes) > 1 else []
        return pa.Table.from_batches([batch_of(schema, list(zip(*links, strict=True)) or [[], []])])

    return groups.join(sets, "node").select("grp", "node", "root", "side", "s").groupBy("grp").applyInArrow(run, "a long, b long")


def chunked_hubs(edges: DataFrame, size: int) -> DataFrame:
    """(hub, chunks): how many chunks of about ``size`` members a hub has."""
    return edges.groupBy("hub").agg(F.ceil((F.count(F.lit(1)) - 1) / size).alias("chunks"))


def hub_groups(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """First round: each hub with its members, in chunks."""
    dealt = edges.filter("hub <> node").join(chunks, "hub").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    heads = chunks.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select("hub", "chunk", F.col("hub").alias("node"))
    return dealt.select("hub", "chunk", "node").unionByName(heads).select(
        F.concat_ws("-", "hub", "chunk").alias("grp"), "node", F.col("node").alias("root"), F.lit(2).alias("side"))


def rare_keys(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """(hub, node) of what the first round has left open: a set stays with the hubs of those keys that it keeps when, of its keys of
    hubs with several chunks, it leaves out, class by class, as many of the largest as it may. A key is as large as its
    hub has chunks, ties go by key: an order that is the same for all sets."""
    schema = arrow_schema(ddl := "hub long, node long")
    large = edges.join(chunks.filter("chunks > 1"), "hub").select("node", F.transform("keys", lambda k: F.struct(
        F.col("chunks").alias("size"), k["key"].alias("key"), k["spare"].alias("spare"), F.col("hub").alias("hub"))).alias("keys"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, flat = b.column(1).offsets.to_numpy(), b.column(1).flatten()
            size, key, spare, hub = (flat.field(c).to_numpy() for c in ("size", "key", "spare", "hub"))
            node = np.repeat(b.column(0).to_numpy(), np.diff(offsets))
            kind = spare & 255
            order = np.lexsort((key, -size, kind, node))
            node, kind, spare, hub = node[order], kind[order], spare[order], hub[order]
            start = np.concatenate([[True], (node[1:] != node[:-1]) | (kind[1:] != kind[:-1])]) if len(node) else np.zeros(0, bool)
            rank = np.arange(len(node)) - np.maximum.accumulate(np.where(start, np.arange(len(node)), 0))
            kept = np.unique(np.stack([hub, node], 1)[rank >= spare >> 8], axis=0)
            yield batch_of(schema, [kept[:, 0], kept[:, 1]])

    # The keys of one set are a few hundred at most times its size.
    per_node = large.groupBy("node").agg(F.flatten(F.collect_list("keys")).alias("keys"))
    return per_node.mapInArrow(run, ddl)


def open_groups(members: DataFrame, roots: DataFrame, size: int) -> DataFrame:
    """Second round: of each hub's members (hub, node) those outside its largest component against each other and against that
    component, in blocks of about ``size``. Hubs of one component are settled."""
    rooted = written(members.join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    by_root = rooted.groupBy("hub", "root").agg(F.count(F.lit(1)).alias("n"))
    hubs = by_root.groupBy("hub").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("all")).filter("all > main.n")
    hubs = written(hubs.select("hub", F.col("main.root").alias("main"), F.ceil(F.col("main.n") / size).alias("inside"),
                               F.ceil((F.col("all") - F.col("main.n")) / size).alias("outside")), "open-hubs")
    out = F.col("root") != F.col("main")
    dealt = rooted.join(hubs, "hub").withColumn("block", F.pmod(F.xxhash64("node"), F.when(out, F.col("outside")).otherwise(F.col("inside"))))
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    apart = dealt.filter(out).withColumn("other", F.explode(numbers("outside"))).select(
        F.concat_ws("-", "hub", F.lit("o"), F.least("block", "other"), F.greatest("block", "other")).alias("grp"), "node", "root",
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"))
    outer = dealt.filter(out).withColumn("other", F.explode(numbers("inside"))).select(
        F.concat_ws("-", "hub", F.lit("m"), "block", "other").alias("grp"), "node", "root", F.lit(0).alias("side"))
    inner = dealt.filter(~out).withColumn("other", F.explode(numbers("outside"))).select(
        F.concat_ws("-", "hub", F.lit("m"), "other", "block").alias("grp"), "node", "root", F.lit(1).alias("side"))
    return apart.unionByName(outer).unionByName(inner)


def set_components(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str, group_sets: int) -> DataFrame:
    """(doc_id, n, digest, root, low): the set of each row of ``docs``, its component and the smallest id there; the last two are null if
    the text has no n-grams, or if no row of that set has an id."""
    rows = written(with_hubs(prints_and_keys(docs, width, percent, id_col, text_col)), "prints")
    prints = rows.filter("n is not null").select(F.col("id").alias("doc_id"), "n", "node", "digest", "sketch")
    # The keys by which a member has a hub are a few hundred at most times its size; two tasks may have put out the same set.
    edges = written(rows.filter("hub is not null").groupBy("hub", "node").agg(F.collect_set(F.struct("key", "spare")).alias("keys")), "edges")
    # For each set the smallest id that carries it; texts are read again by that.
    least = written(prints.filter("digest is not null and doc_id is not null").groupBy("node", "digest").agg(F.min("doc_id").alias("low")), "sets")
    sketches = prints.filter("sketch is not null").select("node", "n", "sketch").distinct()
    chunks = written(chunked_hubs(edges, group_sets), "chunks")

    def round_of(groups: DataFrame) -> DataFrame:
        left = written(possible(groups, sketches, percent), "possible").distinct()
        ids = written(left.select("node").distinct().join(least, "node").select("low").distinct(), "asked")
        return written(links_of(left, sets_of(docs, ids, width, id_col, text_col), percent), "links")

    first = round_of(hub_groups(edges, chunks))
    roots = written(components(first), "roots")
    second = round_of(open_groups(rare_keys(edges, chunks), roots, 2 * group_sets))
    ends = components(first.unionByName(second))
    rooted = least.join(ends, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lows = written(rooted.groupBy("root").agg(F.min("low").alias("least")), "lows")
    ends = written(rooted.join(lows, "root").select("digest", "root", F.col("least").alias("low")), "set-components")
    return prints.select("doc_id", "n", "digest").join(ends, "digest", "left")


def ngram_join(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", group_sets: int = GROUP_SETS) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row: the size of the text's set of ``width``-word n-grams and
    the smallest id reachable by links, documents of Jaccard similarity ``percent`` / 100 or more being linked.

    A-Z are lower-cased; words are cut at ASCII white space; a text with fewer words is one n-gram; null, empty and
    blank texts have an empty set and link with nothing. Repeated rows get the same answer each; rows that share an id but not the text
    are documents of their own, each with the component of its own text. A row with a null id has the component of rows with
    the same set, or none. Other columns are not read; no rows in, no rows out."""
    return set_components(docs, width, percent, id_col, text_col, group_sets).select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("low", "doc_id").alias("component_id"))


def without_near_copies(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id, all columns as they were. If several rows of the component
    have that id, one of those whose set is least by its digest stays. Rows that share an id but not the text are decided each by
    its own text. Rows without n-grams or with a null id stay. Only rows that may go are joined by id and digest of the set."""
    found = written(set_components(docs, width, percent, id_col, text_col, GROUP_SETS).filter("doc_id is not null and digest is not null"), "near-copies")
    sets = found.groupBy("doc_id", "digest", "root", "low").agg(F.count(F.lit(1)).alias("rows"))
    # Of the rows with the smallest id of a component, which share that id, one set stays.
    first = sets.filter("doc_id = low").groupBy("root").agg(F.min("digest").alias("first"), F.count(F.lit(1)).alias("sets"), F.max("rows").alias("rows"), F.min("low").alias("id"))
    clashes = written(first.filter("sets > 1 or rows > 1").select("root", "first", "id"), "near-clashes")
    goes = written(sets.filter("doc_id <> low").select("doc_id", "digest").unionByName(
        sets.filter("doc_id = low").join(clashes, "root").filter("digest <> first").select("doc_id", "digest")), "near-goes")
    again = clashes.select(F.col("id").alias("doc_id"))
    twice = found.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    passed, open_rows = split_by_ids(docs, goes.select("doc_id").unionByName(again).unionByName(twice).distinct(), id_col)
    sha = f"sha_{uuid.uuid4().hex}"
    told = with_digests(open_rows, width, text_col, sha)
    goes = goes.select(F.col("doc_id").alias(id_col), F.col("digest").alias(sha))
    stays = told.join(goes, [id_col, sha], "left_anti")
    # Of rows that repeat the id and the set that stays, one stays; rows without n-grams all do.
    kept_once = stays.filter(F.col(sha).isNotNull()).dropDuplicates([id_col, sha]).unionByName(stays.filter(F.col(sha).isNull()))
    return passed.unionByName(kept_once.select(*docs.columns))


def with_digests(docs: DataFrame, width: int, text_col: str, name: str) -> DataFrame:
    """``docs`` with the digest of each text's set, null for no n-grams, as column ``name``."""
    out = docs.withColumn(name, F.lit(None).cast("binary"))
    place, schema = docs.columns.index(text_col), out.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from crowdgauge.llm.memo import held

        shingler = held(("shingles", width), lambda: Shingler(width))
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                sets = [shingler.shingles(t.as_py() or "") for t in part.column(place)]
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield part.set_column(part.num_columns - 1, part.schema.field(part.num_columns - 1), pa.array(digests, part.schema.field(part.num_columns - 1).type))

    return out.mapInArrow(run, schema)
