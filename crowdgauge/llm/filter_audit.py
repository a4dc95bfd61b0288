"""Filter interaction audit: what each of five filters takes from the corpus in every order, by min-plus removal ranks.

A document is its mask of failed filters. Of an order, the inverse permutation says at which position each filter stands. The step at
which a document goes is the least position among the filters it fails: a min-plus product of the mask matrix (0 where a filter
fails, infinite elsewhere) with the matrix of positions. That step drives everything else: counts of masks are scattered by it,
with weights for labelled documents, and a filter that a document fails later than it goes is redundant there.

Texts are read once, in Arrow batches, to a narrow table of masks and digests. Of equal texts those of the smallest id don't fail
as copies: minima fold before they are shuffled, and rows meet them by (digest, id), so a text that a third of all rows carry
is dealt out by its ids. A part then is 32 masks with three weights each, folded before the shuffle; only these are expanded to orders.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, written

# The filters by letter, and their bounds.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT, SIGNS = 200, 50, 2, b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))


def own_mask(text: str) -> int:
    """Bits of the filters that a text fails by itself: A too few words, B too few different ones, C too many capitals, D a sign."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes: cuts at the six ASCII white-space bytes and nothing else
    return ((len(words) < LEAST_WORDS)
            | (100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words)) << 1
            | (100 * (len(raw) - len(raw.translate(None, CAPITALS))) > MOST_CAPITALS_PERCENT * len(text)) << 2
            | (len(raw) != len(raw.translate(None, SIGNS))) << 3)


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, mask, digest) for each row: what the text fails by itself, and the SHA-256 of the whole text."""
    schema = arrow_schema(ddl := "doc_id long, part string, mask int, digest binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for b in batches:
            for at in range(0, b.num_rows, 500):
                rows = b.slice(at, 500)
                texts = rows.column(2).to_pylist()
                yield batch_of(schema, [rows.column(0).to_pylist(), rows.column(1).to_pylist(), list(map(own_mask, texts)),
                                        [sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts]])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, ddl)


def masks_of(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail just these filters, and how many of them are labelled."""
    rows = written(failures(docs, id_col, text_col, part_col), "failures")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    told = told.filter("good or toxic").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    met = rows.join(first.withColumnsRenamed({"digest": "d", "doc_id": "i"}),
                    (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("i")), "left")
    mask = F.col("mask") + F.when(F.col("first").isNull(), 16).otherwise(0)
    return met.select("doc_id", "part", mask.alias("mask")).join(told, "doc_id", "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def removal_steps(positions: np.ndarray) -> np.ndarray:
    """[mask, order]: the step, from 0, at which a document with this mask goes, or the number of filters if it stays. ``positions``
    is [filter, order]; masks are all subsets of the filters."""
    filters = len(positions)
    fails = (np.arange(1 << filters)[:, None] >> np.arange(filters)) & 1
    cost = np.where(fails == 1, 0, filters)  # the infinite of this semiring: no position is beyond
    steps = np.full((1 << filters, positions.shape[1]), filters)
    for f in range(filters):  # min-plus product, a filter at a time
        np.minimum(steps, cost[:, f:f + 1] + positions[f], out=steps)
    return steps


def audit_of(weights: np.ndarray, orders: np.ndarray) -> dict[str, np.ndarray]:
    """Counts by [order, step] from ``weights`` [mask, (n, good, toxic)] and ``orders`` [order, step] of filters."""
    n_orders, filters = orders.shape
    positions = np.argsort(orders, axis=1).T
    steps = removal_steps(positions)
    out = np.zeros((3, n_orders, filters + 1), np.int64)
    for k in range(3):  # scatter: each mask's weight goes to the step it is removed at
        np.add.at(out[k], (np.arange(n_orders)[None, :], steps), weights[:, k:k + 1])
    removed, good, toxic = out[0][:, :filters], out[1][:, :filters], out[2][:, :filters]
    masks = np.arange(1 << filters)
    failing = (masks[:, None, None] >> orders[None]) & 1  # [mask, order, step]: fails the filter of this step
    late = failing.astype(bool) & (steps[:, :, None] < np.arange(filters))
    by_filter = np.zeros(filters, np.int64)
    np.add.at(by_filter, orders, removed)
    return {"kept": weights[:, 0].sum() - np.cumsum(removed, axis=1), "removed": removed,
            "redundant": np.einsum("m,mos->os", weights[:, 0], late.astype(np.int64)),
            "unique_fails": weights[1 << orders, 0], "good_lost": good, "toxic_lost": toxic, "shapley": by_filter[orders]}


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
AUDIT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def audited(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """AUDIT rows, one for each part, order of the filters and step, from (part, mask, n, good, toxic)."""
    schema = arrow_schema(AUDIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = np.array(list(permutations(range(len(filters)))))
        names = ["".join(filters[f] for f in order) for order in orders for _ in order]
        for b in batches:
            for part, told in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                weights = np.zeros((1 << len(filters), 3), np.int64)
                for m in told:
                    weights[m["mask"]] += (m["n"], m["good"], m["toxic"])
                got = audit_of(weights, orders)
                yield batch_of(schema, [[part] * len(names), names, np.tile(np.arange(1, orders.shape[1] + 1), len(orders)),
                                        *[got[c].ravel() for c in COUNTS]])

    return masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("told")).mapInArrow(run, AUDIT)


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """AUDIT rows of the five filters over whole texts: for each part, each of the 120 orders and each step, what the step's filter does.

    Null text is empty text, a null part is the empty string. Of equal texts all rows of the smallest id pass filter E; a null
    id is larger than any other, so it passes only where no row with an id has the text. Repeated rows count each. Several label rows of one
    id count as one that says yes where any of them does; null labels say no. Other columns are not read. No documents, no
    rows; no labels, no losses."""
    return audited(masks_of(docs, labels, id_col, text_col, part_col))
