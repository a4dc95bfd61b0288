"""Vector code compression: vectors as one code byte a part, by dual-tree Lloyd rounds over integer components.

Vectors are cut into equal parts and put into bounded blocks; for each part of a block a tree is built once and written with it: nodes
with their boxes, sums and counts. A round sets a tree over the codebook's entries against the tree over the parts. A pair of nodes is
left when the least distance of their boxes exceeds the most that another entry node is away; once only single entries are left, one
that is nowhere in the box nearer than another goes, too. A node with one entry left is assigned whole, by its cached sum and
count; otherwise it is split. Leaves that stay uncertain measure their few parts against the entries left. Boxes, sums and
distances are integers, so a tie is a tie and goes to the lower index.

Blocks pass on a sum and a count for each entry, which Spark folds; the driver sees one codebook a round, whose size is
parts x entries x width, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
BLOCK, LEAF = 4096, 16
LARGEST = 1 << 24  # integers of that size and more are not coded: a squared distance of a part has to fit 64 bits


@dataclass
class Tree:
    """A k-d tree: node ``k`` covers ``order[start[k]:end[k]]``; ``left`` is -1 at leaves, the right child is the next node."""

    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray

    def packed(self) -> list[bytes]:
        return [x.astype("<i8").tobytes() for x in (self.order, self.start, self.end, self.left, self.low, self.high, self.total)]

    @classmethod
    def unpacked(cls, data: list[bytes], width: int) -> Tree:
        flat = [np.frombuffer(x, "<i8") for x in data]
        return cls(*flat[:4], *(x.reshape(-1, width) for x in flat[4:]))


def tree_of(points: np.ndarray, leaf: int) -> Tree:
    """Splits at the median of the widest side until ``leaf`` points, or equal ones, are left."""
    order, spans, left, k = np.arange(len(points)), [(0, len(points))], [], 0
    while k < len(spans):
        a, b = spans[k]
        own = points[order[a:b]]
        wide = own.max(0) - own.min(0)
        side = int(wide.argmax())
        if b - a <= leaf or not wide[side]:
            left.append(-1)
        else:
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, side], mid, kind="introselect")]
            left.append(len(spans))
            spans += [(a, a + mid), (a + mid, b)]
        k += 1
    start, end = np.array(spans).T
    cells = [points[order[a:b]] for a, b in spans]
    return Tree(order, start, end, np.array(left), *(np.array([f(c, 0) for c in cells]) for f in (np.min, np.max, np.sum)))


def box_distances(t: Tree, p: np.ndarray, u: Tree, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distances between the boxes of nodes ``p`` and ``e``, pair by pair."""
    gap = np.maximum(0, np.maximum(u.low[e] - t.high[p], t.low[p] - u.high[e]))
    far = np.maximum(u.high[e] - t.low[p], t.high[p] - u.low[e])
    return (gap * gap).sum(1), (far * far).sum(1)


def first_of(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal sorted keys begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


def assigned(points: np.ndarray, tree: Tree, book: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The nearest entry of each point, and the nodes that were assigned whole as (node, entry)."""
    entries = tree_of(book, 1)
    # Leaves of the entry tree hold one entry, or equal ones, of which only the lowest index can win.
    single = entries.left < 0
    entry = np.array([entries.order[a:b].min() for a, b in zip(entries.start, entries.end)])
    wide = lambda t: ((t.high - t.low) ** 2).sum(1)
    point_width, entry_width = wide(tree), np.where(single, -1, wide(entries))
    codes, whole = np.full(len(points), -1, np.int64), []
    node, other = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(node):
        at = first_of(node)
        sizes = np.diff(np.append(at, len(node)))
        least, most = box_distances(tree, node, entries, other)
        keep = least <= np.repeat(np.minimum.reduceat(most, at), sizes)
        node, other = node[keep], other[keep]
        at = first_of(node)
        sizes = np.diff(np.append(at, len(node)))
        widest = np.maximum.reduceat(entry_width[other], at)
        ready = np.repeat(widest < 0, sizes)  # only single entries are left
        if ready.any():
            keep = ~ready | near_enough(tree, node, book, np.where(ready, entry[other], 0))
            node, other, ready = node[keep], other[keep], ready[keep]
            at = first_of(node)
            sizes = np.diff(np.append(at, len(node)))
            widest = np.maximum.reduceat(entry_width[other], at)
        alone = (sizes == 1) & (widest < 0)
        for k in at[alone]:
            n, e = int(node[k]), int(entry[other[k]])
            codes[tree.order[tree.start[n]:tree.end[n]]] = e
            whole.append((n, e))
        leaf = tree.left[node[at]] < 0
        unsure = ~alone & (widest < 0) & leaf
        measure(points, tree, book, *(x[np.repeat(unsure, sizes)] for x in (node, entry[other])), codes)
        split = ~alone & ~leaf & (point_width[node[at]] >= widest)
        down = np.repeat(split, sizes)
        opened = np.repeat(~alone & ~split & ~unsure, sizes)
        inner = opened & ~single[other]
        pairs = [(tree.left[node[down]], other[down]), (tree.left[node[down]] + 1, other[down]),
                 (node[inner], entries.left[other[inner]]), (node[inner], entries.left[other[inner]] + 1),
                 (node[opened & single[other]], other[opened & single[other]])]
        node, other = (np.concatenate(x) for x in zip(*pairs))
        rank = np.lexsort((other, node))
        node, other = node[rank], other[rank]
    return codes, whole


def near_enough(tree: Tree, node: np.ndarray, book: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """For pairs of nodes and entries, sorted by node, whether some place in the box may be won by the entry: it is held against
    the entry nearest to the middle of the box. The difference of two squared distances is linear, so its least value
    over the box stands in a corner."""
    middle = tree.low[node] + tree.high[node]
    off = ((middle - 2 * book[entry]) ** 2).sum(1)
    at = first_of(node)
    sizes = np.diff(np.append(at, len(node)))
    nearest = np.repeat(np.minimum.reduceat(off, at), sizes) == off
    winner = np.repeat(np.minimum.reduceat(np.where(nearest, entry, len(book)), at), sizes)
    step = book[winner] - book[entry]  # |x - entry|^2 - |x - winner|^2 = 2 x.step + |entry|^2 - |winner|^2
    corner = np.where(step > 0, tree.low[node], tree.high[node])
    lead = 2 * (corner * step).sum(1) + (book[entry] ** 2).sum(1) - (book[winner] ** 2).sum(1)
    return (lead < 0) | (lead == 0) & (entry <= winner)


def measure(points: np.ndarray, tree: Tree, book: np.ndarray, node: np.ndarray, entry: np.ndarray, codes: np.ndarray, step: int = 4096) -> None:
    """Assigns the parts of leaves one by one among the entries left, by exact distances."""
    if not len(node):
        return
    at = np.append(first_of(node), len(node))
    k = 0
    while k < len(at) - 1:
        stop = max(k + 1, int(np.searchsorted(at, at[k] + step, "right")) - 1)
        nodes, tried = node[at[k]:at[stop]], entry[at[k]:at[stop]]
        size = int((tree.end[nodes] - tree.start[nodes]).max())
        place = np.minimum(tree.start[nodes][:, None] + np.arange(size), tree.end[nodes][:, None] - 1)
        own = tree.order[place]
        off = ((points[own] - book[tried][:, None, :]) ** 2).sum(2)
        runs = at[k:stop] - at[k]
        sizes = np.diff(np.append(runs, len(nodes)))
        best = np.repeat(np.minimum.reduceat(off, runs, axis=0), sizes, axis=0)
        codes[own[runs].ravel()] = np.minimum.reduceat(np.where(off == best, tried[:, None], len(book)), runs, axis=0).ravel()
        k = stop


def summed(points: np.ndarray, tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum for each entry: cached sums of nodes assigned whole, single parts otherwise."""
    codes, whole = assigned(points, tree, book)
    counts, sums = np.zeros(len(book), np.int64), np.zeros_like(book)
    for n, e in whole:
        codes[tree.order[tree.start[n]:tree.end[n]]] = -1
        counts[e] += tree.end[n] - tree.start[n]
        sums[e] += tree.total[n]
    rest = codes >= 0
    np.add.at(counts, codes[rest], 1)
    np.add.at(sums, codes[rest], points[rest])
    return counts, sums


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(vec_id, label, v): kept vectors as integers; label as text, so that equal labels stay equal and null stays null."""
    v = F.col("v")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < float(LARGEST))
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("v"))
    return kept.filter(v.isNotNull() & F.forall(v, finite)).withColumn("v", F.transform(v, lambda x: F.floor(x * scale).cast("long")))


BLOCKS = "vec_id array<long>, label array<string>, points array<binary>, trees array<array<binary>>"


def in_blocks(kept: DataFrame, dim: int, parts: int, block: int) -> DataFrame:
    """BLOCKS of at most ``block`` vectors of ``dim`` components, each part with its tree. A width that is no multiple of
    ``parts`` is filled up with zeros, which leave distances as they are."""
    schema, width = arrow_schema(BLOCKS), max(1, -(-dim // parts))

    def row(ids: list, labels: list, rows: list[np.ndarray]) -> pa.RecordBatch:
        full = np.zeros((len(ids), width * parts), np.int64)
        full[:, :dim] = np.concatenate(rows)
        own = [np.ascontiguousarray(full[:, p * width:(p + 1) * width]) for p in range(parts)]
        return batch_of(schema, [[ids], [labels], [[x.astype("<i8").tobytes() for x in own]], [[tree_of(x, LEAF).packed() for x in own]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, rows = [], [], []
        for b in batches:
            b = b.filter(pa.array(np.array([len(x) == dim for x in b.column(2)], bool)))
            flat = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if b.num_rows else np.zeros((0, dim), np.int64)
            for at in range(0, b.num_rows, block):
                stop = at
                while stop < min(b.num_rows, at + block):
                    start, stop = stop, min(b.num_rows, at + block, stop + block - len(ids))
                    ids += b.column(0)[start:stop].to_pylist()
                    labels += b.column(1)[start:stop].to_pylist()
                    rows.append(flat[start:stop])
                    if len(ids) == block:
                        yield row(ids, labels, rows)
                        ids, labels, rows = [], [], []
        if ids:
            yield row(ids, labels, rows)

    return kept.mapInArrow(run, BLOCKS)


def unpack(row: dict, width: int, parts: int) -> list[tuple[np.ndarray, Tree]]:
    return [(np.frombuffer(row["points"][p], "<i8").reshape(-1, width), Tree.unpacked(row["trees"][p], width)) for p in range(parts)]


def lloyd_round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks [part, entry, component] after one round; entries that no part chose stay."""
    schema = arrow_schema(ddl := "part int, entry int, n long, total array<long>")
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros_like(books)
        for b in batches:
            for k in range(b.num_rows):
                for p, (points, tree) in enumerate(unpack(b.slice(k, 1).to_pylist()[0], width, parts)):
                    n, total = summed(points, tree, books[p])
                    counts[p] += n
                    sums[p] += total
        p, e = np.nonzero(counts)
        yield batch_of(schema, [p, e, counts[p, e], list(sums[p, e])])

    # A total is folded component by component as decimals, which don't run over.
    got = blocks.select("points", "trees").mapInArrow(run, ddl).groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(k)).cast("decimal(20,0)")) for k in range(width)]).alias("total"))
    books = books.copy()
    for r in got.collect():  # at most parts x entries rows
        books[r.part, r.entry] = [int(t) // r.n for t in r.total]
    return books


def trained_books(kept: DataFrame, blocks: DataFrame, dim: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks [part, entry, component]: they start as the vectors of the smallest ids, ``rounds`` Lloyd rounds follow."""
    width = max(1, -(-dim // parts))
    first = kept.filter(F.size("v") == dim).orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    books = np.zeros((parts, len(first), width * parts), np.int64)[:, :, :width].copy()
    for e, r in enumerate(first):
        full = np.zeros(width * parts, np.int64)
        full[:dim] = r.v
        books[:, e] = full.reshape(parts, width)
    for _ in range(rounds):
        books = lloyd_round(blocks, books)
    return books


def coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) by the codebooks."""
    schema = arrow_schema(ddl := "vec_id long, label string, code string, error long")
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                codes, error = [], 0
                for p, (points, tree) in enumerate(unpack(row, width, parts)):
                    own, _ = assigned(points, tree, books[p])
                    codes.append(own)
                    error = error + ((points - books[p][own]) ** 2).sum(1)
                yield batch_of(schema, [row["vec_id"], row["label"], ["".join(f"{c:02x}" for c in x) for x in zip(*codes)], error])

    return blocks.mapInArrow(run, ddl)


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
                 entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), a row for each kept row.

    Rows whose vector is null, holds null or non-finite components, or components of which ``scale`` times is 2^24 or more, are dropped.
    The width is that of the kept vector of the smallest id; vectors of another width (empty ones, too, unless it is empty itself) are dropped.
    A width that is no multiple of ``parts`` is filled up with zeros. Fewer vectors than ``entries`` give as many entries as there
    are vectors. Null ids come last, of rows that repeat an id the smaller vector comes first; each gets a row. Null labels form one
    group. Other columns are not read. No rows in, no rows out."""
    kept = integers(vectors, id_col, vector_col, label_col, scale)
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "v").select(F.size("v").alias("dim")).first()
    dim = first.dim if first else 0
    if not dim:  # no vectors, or such as hold nothing: no part differs from any other
        none = kept.filter(F.size("v") == 0).select("vec_id", F.lit("00" * parts).alias("code"), F.lit(0).cast("long").alias("error"),
                                                    F.lit(0).cast("long").alias("label_error"))
        return none.withColumn("codebooks_sha256", F.lit(books_digest(np.zeros(0, np.int64))))
    blocks = written(in_blocks(kept, dim, parts, block), "vector-blocks")
    books = trained_books(kept, blocks, dim, parts, entries, rounds)
    codes = written(coded(blocks, books), "vector-codes")
    by_label = codes.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("l"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
