"""Quality rules: gradient-boosted trees over document statistics.

The statistics of a text come from one pass over it. Trees are grown on the driver from a bounded sample of
labelled rows (``sample_rows``), by histogram splits with Newton leaf values. Features named in
``MONOTONE`` may only raise (+1) or lower (-1) the score: a split that would go the other way is not
taken, and the children of an accepted one stay on their sides of its midpoint. A fitted forest is five
numpy arrays, all trees one after the other, so scoring a batch is a few array steps per level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, filtered, id_and_text

SAMPLE_ROWS = 6_000  # bound of the labelled rows that the trees are fitted on
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_SCORE = 0.2  # a document is rejected only if the trees are this sure
SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share",
            "mark_share", "distinct_share", "long_share", "line_words", "punctuated_share")
# +1: more of it can only raise the score that a document is good, -1: only lower it.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "mark_share": -1}


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    total, end = 0, 0
    for at, w in enumerate(windows):
        if seen[w] > 1:
            total += at + 3 - max(at, end)
            end = at + 3
    return total


def statistics(text: str) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """(BASE, FEATURES) of one text. bytes.split() cuts at exactly the six ASCII white-space bytes."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    spaces = len(raw) - len(raw.translate(None, SPACE))
    chars = len(text) - spaces
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    dup = len(lines) - len(set(lines))
    repeated = repeat_words(words)
    marks = sum(map(raw.count, (b"%", b"!", b"|", b"$", b"#", b"*", b"&")))
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    ends = len(raw) - len(raw.translate(None, b".,;:?"))
    share = lambda x, of: x / of if of else 0.0
    features = (math.log1p(n), share(chars, n), share(symbols, chars), share(dup, len(lines)), share(repeated, n),
                share(upper, chars), share(digits, chars), share(marks, chars), share(len(set(words)), n),
                share(sum(len(w) > 20 for w in words), n), math.log1p(share(n, len(lines))), share(ends, n))
    return (n, chars, symbols, dup, repeated), features


@dataclass
class Forest:
    """All trees in flat arrays; a leaf points at itself. score() walks all rows and trees level by level."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of a good document per row of ``x``."""
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                goes_left = x[rows, self.feature[at]] <= self.threshold[at]
                at = np.where(goes_left, self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 2.0,
         least: float = 1.0, monotone: dict[int, int] | None = None) -> Forest:
    """Fits a forest to 0/1 labels. Without rows of both classes it has no trees and every score is 0.5."""
    monotone = monotone or {}
    share = float(y.mean()) if len(y) and 0 < y.sum() < len(y) else 0.5
    bias = math.log(share / (1 - share))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T] if len(x) else []
    codes = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)]) if len(x) else x

    def leaf(v: float) -> int:
        k = len(value)
        for a, b in ((feature, 0), (threshold, math.inf), (left, k), (right, k), (value, v)):
            a.append(b)
        return k

    def fit(g: float, h: float, low: float, high: float) -> float:
        return min(max(g / (h + ridge), low), high)

    def split(idx: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, level: int) -> int:
        gs, hs = float(g[idx].sum()), float(h[idx].sum())
        best, chosen = 1e-6, None
        if level < depth:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                gl = np.cumsum(np.bincount(codes[idx, f], g[idx], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(codes[idx, f], h[idx], len(e) + 1))[:-1]
                gr, hr = gs - gl, hs - hl
                wl, wr = np.clip(gl / (hl + ridge), low, high), np.clip(gr / (hr + ridge), low, high)
                gain = gl * wl - wl * wl * (hl + ridge) / 2 + gr * wr - wr * wr * (hr + ridge) / 2
                bad = (hl < least) | (hr < least) | ((wr - wl) * monotone.get(f, 0) < 0)
                gain = np.where(bad, -math.inf, gain)
                k = int(gain.argmax())
                w = fit(gs, hs, low, high)
                won = gain[k] - (gs * w - w * w * (hs + ridge) / 2)
                if won > best:
                    best, chosen = won, (f, k, float(wl[k]), float(wr[k]))
        if chosen is None:
            return leaf(rate * fit(gs, hs, low, high))
        f, k, wl, wr = chosen
        at = leaf(0.0)
        feature[at], threshold[at] = f, float(edges[f][k])
        low_l, high_l, low_r, high_r = low, high, low, high
        if way := monotone.get(f, 0):
            mid = (wl + wr) / 2
            high_l, low_r = (mid, mid) if way > 0 else (high_l, low_r)
            low_l, high_r = (mid, mid) if way < 0 else (low_l, high_r)
        goes_left = codes[idx, f] <= k
        left[at] = split(idx[goes_left], g, h, low_l, high_l, level + 1)
        right[at] = split(idx[~goes_left], g, h, low_r, high_r, level + 1)
        return at

    def forest() -> Forest:
        return Forest(np.array(feature, int), np.array(threshold, float), np.array(left, int), np.array(right, int),
                      np.array(value, float), np.array(roots, int), bias, depth + 1)

    if len(y) and 0 < y.sum() < len(y):
        total = np.full(len(y), bias)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-total))
            start = len(value)
            roots.append(split(np.arange(len(y)), y - p, np.maximum(p * (1 - p), 1e-9), -math.inf, math.inf, 0))
            one = Forest(np.array(feature[start:], int), np.array(threshold[start:], float), np.array(left[start:], int) - start,
                         np.array(right[start:], int) - start, np.array(value[start:], float), np.array([roots[-1] - start]), 0.0, depth + 1)
            at = np.full(len(y), one.roots[0])
            for _ in range(one.depth):
                at = np.where(x[np.arange(len(y)), one.feature[at]] <= one.threshold[at], one.left[at], one.right[at])
            total = total + one.value[at]
    return forest()


def sampled_labels(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids, chosen by a hash of the id, as (doc_id, label). Its size is bounded by
    ``rows``, so it may be broadcast."""
    per_id = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col(label).cast("int")).alias("label"))
    return per_id.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fitted(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, monotone: dict[str, int] | None = None) -> Forest:
    """The forest of a bounded sample of labelled documents: at most ``sample_rows`` rows of twelve numbers
    reach the driver. Labels without a document, and documents without a label, are not used."""
    wanted = sampled_labels(labels, "quality", sample_rows)
    texts = id_and_text(docs).join(F.broadcast(wanted), "doc_id")
    schema = arrow_schema("doc_id long, label int, x array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, label = (b.column(k).to_pylist() for k in range(3))
            yield batch_of(schema, [ids, label, [statistics(t)[1] for t in texts]])

    rows = texts.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, x array<double>").toArrow()
    order = np.lexsort((np.arange(rows.num_rows), rows["doc_id"].to_numpy()))
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(FEATURES))[order]
    y = rows["label"].to_numpy().astype(float)[order]
    places = {FEATURES.index(k): v for k, v in (MONOTONE if monotone is None else monotone).items()}
    return grow(x, y, monotone=places)


def verdicts(texts: list[str], forest: Forest, min_score: float) -> tuple[list, list[bool], list[float], list[bool]]:
    """(BASE per text, base_failed, score, kept)."""
    base, x = zip(*map(statistics, texts), strict=True)
    score = forest.score(np.array(x, float)).tolist()
    failed = [n < MIN_WORDS or 100 * r > MAX_REPEAT_PERCENT * n for n, *_, r in base]
    return base, failed, score, [not f and s >= min_score for f, s in zip(failed, score, strict=True)]


def quality_rules(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, BASE, base_failed, score, kept), one row per input row, from one pass without a shuffle.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated 3-word windows. ``kept``:
    not base_failed and a score of at least ``min_score``. Null and empty texts have no words and fail. Rows
    that repeat get the same answer each, null ids stay null, other columns are not read."""
    ddl = ("doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, score double, kept boolean")
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                base, failed, score, kept = verdicts(b.column(1).to_pylist(), forest, min_score)
                yield batch_of(schema, [b.column(0).to_pylist(), *map(list, zip(*base, strict=True)), failed, score, kept])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, ddl)


def passing(docs: DataFrame, forest: Forest, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, all columns as they were, in one pass without a join."""
    return filtered(docs, text_col, lambda: lambda texts: verdicts(texts, forest, min_score)[3])
