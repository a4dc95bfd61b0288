"""Toxicity: noisy-channel restoration of disguised words, then a score of the restored text.

A token that may be disguised (digits or signs among letters, a letter three times in a row, separators
between letters, or a run of single letters) opens a lattice: each place offers the letters it may stand
for, a run offers one or two copies, a separator offers nothing. Viterbi decoding takes the path that a
character trigram model finds likeliest, each change paying for itself. Plain tokens have one path only.

Words and their beginnings and ends get log odds from labelled documents (a document counts once), drawn to 0 by
PRIOR documents; a greedy cover keeps the few that explain the toxic rows. A token weighs as much as its best
part. The two heaviest tokens and the length of a text go into a logistic
score, fitted on labelled rows that the odds have not seen. Labels are only read from rows whose
crc32(doc_id) mod 4 is not 2, from all of them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from heapq import nlargest
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memo import Memo
from .common import arrow_schema, batch_of, filtered, id_and_text, split_by_ids, written

LEXICON_PARTS = 20_000  # bound of the word parts that are kept, by their odds
THRESHOLD = 0.3
PRIOR = 4.0  # documents whose weight the average has against what was counted
LEAST_ODDS = 1.0
SURE_ODDS = 3.5
COVER = 3  # toxic rows that a word part must explain
CACHE = 120_000  # tokens a worker remembers, long ones never
HELD = 400_000  # counts a worker holds before it passes them on
FILTER_MOST = 1 << 25  # bits of the filter of word parts that tasks carry: 4 MB

# The letters a sign may stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
         "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "<": "c"}
SEPARATORS = "._-*~'`^​­·"
EDGE = ".,;:?!\"'()[]{}<>«»“”„…*#%&|$"
OPENING, CLOSING = "\"'([{<«“„", ".,;:?!\"')]}>»“”…"
# Log probabilities: a sign for a letter, a separator, another character that means nothing, a word end in a spaced run.
CHANGE, DROP, LOSE, SPLIT = -2.5, -1.0, -9.0, 0.0
LETTER, THRICE = re.compile(r"[^\W\d_]"), re.compile(r"([^\W\d_])\1\1")
SIGN, SEPARATOR = re.compile("[0-9@$!|+€£¡(<]"), re.compile(f"[{re.escape(SEPARATORS)}]")
DOTTED = re.compile(f"(?:[^{re.escape(SEPARATORS)}]{SEPARATOR.pattern}){{2}}[^{re.escape(SEPARATORS)}]")
START = "\x02\x02"
END = "\x03"


def held_out(doc_id: Column) -> Column:
    """Rows whose labels must not be read; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def parts(word: str) -> list[str]:
    """The word, its beginnings and its ends."""
    return [f"={word}", *(f"^{word[:k]}" for k in range(3, min(7, len(word)))), *(f"{word[-k:]}$" for k in range(4, min(7, len(word))))]


def tokens(text: str) -> list[str]:
    return [w.strip(EDGE) or w for w in text.lower().split()]


def suspect(token: str) -> bool:
    """A letter and a sign, a letter three times in a row, or a separator between letters; in time linear in the token."""
    first = LETTER.search(token)
    if not first:
        return False
    if SIGN.search(token) or THRICE.search(token):
        return True
    last = len(token) - LETTER.search(token[::-1]).end()
    return SEPARATOR.search(token, first.end(), last) is not None


def spaced_runs(text: str, least: int = 3) -> list[str]:
    """Runs of at least ``least`` single characters that stand alone but for signs at their edges, joined. A run ends where such
    a sign closes a clause or opens one; where signs stand at two gaps in a row they belong to the spelling (``i. d. i. o. t.``)."""
    found: list[str] = []
    run: list[tuple[str, bool, bool]] = []
    for w in [*text.lower().split(), ""]:
        c = w.strip(EDGE) or w
        if len(c) == 1:
            at = w.index(c)
            run.append((c, any(x in OPENING for x in w[:at]), any(x in CLOSING for x in w[at + 1:])))
            continue
        gaps = [False, *(a[2] or b[1] for a, b in zip(run, run[1:])), False]  # gaps[k] stands before character k
        piece: list[str] = []
        for k, (x, _, _) in enumerate(run):
            if gaps[k] and not gaps[k - 1] and not gaps[k + 1]:
                found.append("".join(piece))
                piece = []
            piece.append(x)
        found.append("".join(piece))
        run = []
    return [r for r in found if len(r) >= least and sum(c.isalpha() for c in r) >= 2]


def three_on_end(words: list[str], single: set[str]) -> bool:
    """Do three words of ``single`` stand on end? Shorter runs spell nothing."""
    at = [k for k, w in enumerate(words) if w in single]
    return any(c - a == 2 for a, c in zip(at, at[2:]))


@dataclass
class Model:
    """Everything learnt: odds of word parts, character trigrams, and the logistic weights."""

    odds: dict[str, float] = field(default_factory=dict)
    trigrams: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] = (-3.0, 0.0, 0.0, 0.0)

    def step(self, context: str, c: str) -> float:
        """Log probability of ``c`` after two characters; unseen trigrams share a floor."""
        return self.trigrams.get(context + c, -9.0)

    def decode(self, token: str, spaced: bool = False) -> list[str]:
        """The likeliest words behind a disguised token."""
        paths: dict[str, tuple[float, tuple | None]] = {START: (0.0, None)}  # what a path said is linked backwards, so paths share it
        for c, n in runs_of(token):
            options = [(o * k, cost) for o, cost in choices(c) for k in ((1, 2) if n > 1 else (1,)) if o or k == 1]
            if n == 2 and c.isalpha():
                options = [(c * 2, 0.0)]
            after: dict[str, tuple[float, tuple | None]] = {}
            for context, (score, out) in paths.items():
                starts = [(context, score, out)]
                if spaced and out and out[1] != " ":
                    starts.append((START, score + self.step(context, END) + SPLIT, (out, " ")))
                for ctx, base, said in starts:
                    for o, cost in options:
                        s, x = base + cost, ctx
                        for letter in o:
                            s += self.step(x, letter)
                            x = x[1:] + letter
                        if x not in after or after[x][0] < s:
                            after[x] = (s, (said, o) if o else said)
            paths = after
        ends = [(score + self.step(context, END), out) for context, (score, out) in paths.items()]
        best = max((score for score, _ in ends), default=0.0)
        return max((said_by(out) for score, out in ends if score == best), default="").split()

    def weight(self, word: str) -> float:
        return max((self.odds.get(p, 0.0) for p in parts(word)), default=0.0)

    def token_weight(self, token: str) -> float:
        """Of the token as it stands, and of what it restores to."""
        best = self.weight(token)
        if suspect(token):
            best = max([best, *map(self.weight, self.decode(token))])
            if DOTTED.search(token):  # single letters between separators may be several words
                best = max([best, *map(self.weight, self.decode(token, spaced=True))])
        return best

    def features(self, text: str, memo: Memo) -> tuple[float, float, float]:
        """The two heaviest tokens, and the log of the number of tokens. What a word of the text weighs is told once, with its signs at
        the edges, and whether it stands for a single character."""
        words = text.lower().split()
        heavy: list[float] = []
        single = set()
        for w in set(words):
            known = memo.get(w)
            if known is None:
                token = w.strip(EDGE) or w
                known = memo.put(w, (self.token_weight(token), len(token) == 1))
            v, alone = known
            if v:
                heavy += [v] * min(words.count(w), 2)
            if alone:
                single.add(w)
        if single and three_on_end(words, single):
            for run in spaced_runs(text):
                heavy += [v for w in self.decode(run, spaced=True) if (v := self.weight(w))]
        first, second = [*nlargest(2, heavy), 0.0, 0.0][:2]
        return first, second, math.log1p(len(words))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights[1:]) + self.weights[0], -50, 50)))


def said_by(out: tuple | None) -> str:
    pieces = []
    while out:
        out, piece = out
        pieces.append(piece)
    return "".join(reversed(pieces))


def runs_of(token: str) -> Iterator[tuple[str, int]]:
    at = 0
    while at < len(token):
        end = at
        while end < len(token) and token[end] == token[at]:
            end += 1
        yield token[at], end - at
        at = end


def choices(c: str) -> list[tuple[str, float]]:
    if c.isalpha():
        return [(c, 0.0)]
    return [*((o, CHANGE) for o in SIGNS.get(c, "")), ("", DROP if c in SEPARATORS else LOSE * (1 + (c in SIGNS)))]


def counted(batches: Iterator[pa.RecordBatch], most: int = HELD, grams_only: bool = False, grams: bool = True,
            wanted: Callable[[list[str]], list[bool]] | None = None) -> Iterator[tuple[list, list, list, list]]:
    """(kind, part, toxic, clean) of batches of (text, label): documents of either label that hold a word part, and trigrams of
    their words, once for each document and word; with ``grams_only`` no word parts, without ``grams`` no trigrams, with ``wanted`` only the parts that it
    lets through. Sums are given away when they hold ``most`` entries."""
    known: dict[str, list[str]] = {}  # the parts of words that are counted
    words_of: tuple[Counter, Counter] = Counter(), Counter()  # in clean and in toxic documents
    parts_of: tuple[Counter, Counter] = Counter(), Counter()
    grams_of: tuple[Counter, Counter] = Counter(), Counter()

    def learn(words: list[str]) -> dict[str, list[str]]:
        """The parts of words, all of them asked for at once."""
        made = [parts(w) for w in words]
        if wanted is None:
            return dict(zip(words, made, strict=True))
        through = iter(wanted([*chain.from_iterable(made)]))
        return {w: [p for p in own if next(through)] for w, own in zip(words, made, strict=True)}

    def spell() -> None:
        for words, out in zip(words_of, grams_of, strict=True):
            for w, n in words.items():
                padded = START + w + END
                for k in range(len(padded) - 2):
                    out[padded[k:k + 3]] += n
            words.clear()

    def told() -> tuple[list, list, list, list]:
        columns: tuple[list, list, list, list] = [], [], [], []
        for kind, (clean, toxic) in (("part", parts_of), ("gram", grams_of)):
            keys = [*(clean.keys() | toxic.keys())]
            for column, values in zip(columns, ([kind] * len(keys), keys, [toxic[k] for k in keys], [clean[k] for k in keys]), strict=True):
                column += values
            clean.clear()
            toxic.clear()
        return columns

    for b in batches:
        texts = [{w for w in tokens(t) if w.isalpha()} for t in b.column(0).to_pylist()]
        if not grams_only:
            new = [w for w in set(chain.from_iterable(texts)) if w not in known]
            if len(known) + len(new) > CACHE:
                known.clear()
                new = [*set(chain.from_iterable(texts))]
            known.update(learn(new))
        for words, label in zip(texts, b.column(1).to_pylist(), strict=True):
            if grams:
                words_of[bool(label)].update(words)
            if not grams_only:
                parts_of[bool(label)].update(set(chain.from_iterable(map(known.__getitem__, words))))
            if sum(map(len, words_of)) >= most:
                spell()
            if sum(map(len, (*parts_of, *grams_of))) >= most:
                yield told()
    spell()
    if any(parts_of) or any(grams_of):
        yield told()


def among(found: DataFrame) -> Callable[[list[str]], list[bool]] | None:
    """Tells of word parts whether they may be among the column ``part`` of ``found``: a filter of 16 to 32 bits a part, or none where that is
    more than tasks should carry."""
    bits = 1 << max(15, (16 * found.count()).bit_length())
    if bits > FILTER_MOST:
        return None
    place = F.crc32(F.col("part").cast("binary")) % bits
    words = found.select(place.alias("place")).groupBy(F.expr("shiftright(place, 6)").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS int))")).alias("w")).toArrow()
    held = np.zeros(bits >> 6, np.int64)
    held[words.column("word").to_numpy()] = words.column("w").to_numpy()
    packed = held.view(np.uint8)

    def told(words: list[str]) -> list[bool]:
        at = np.fromiter((crc32(w.encode()) for w in words), np.int64, len(words)) % bits
        return ((packed[at >> 3] >> (at & 7)) & 1).astype(bool).tolist()

    return told


def newton(sums: Callable[[np.ndarray], np.ndarray]) -> tuple[float, ...]:
    """Newton steps for a logistic regression; the token weights can't be negative. ``sums`` gives, for weights, the gradient and
    below it the curvature of the log likelihood over all rows, as one array."""
    ridge = np.array([1e-4, 0.05, 0.05, 1.0])  # the length may only correct what the tokens say
    w = np.zeros(len(ridge))
    for _ in range(50):
        found = sums(w)
        step = np.linalg.solve(found[1:] + np.diag(ridge), found[0] - ridge * w)
        w = w + step
        if abs(step).max() < 1e-6:
            break
    w[1:3] = np.maximum(w[1:3], 0)
    return tuple(round(v, 9) for v in w.tolist())  # sums of floats differ in the last digits by how rows are dealt


def slopes(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and curvature of some rows."""
    a = np.column_stack([np.ones(len(x)), x])
    p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
    return np.vstack([a.T @ (y - p), (a.T * (p * (1 - p))) @ a])


def fitted(rows: DataFrame) -> tuple[float, ...]:
    """The logistic weights over all of (label, x). Each task sums its rows, only sums reach the driver."""
    schema = arrow_schema("sums array<double>")

    def sums(w: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((len(w) + 1, len(w)))
            for b in batches:
                if b.num_rows:
                    x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(w) - 1)
                    out += slopes(x, b.column(0).to_numpy(zero_copy_only=False).astype(float), w)
            yield batch_of(schema, [[out.ravel().tolist()]])

        found = rows.select("label", "x").mapInArrow(run, "sums array<double>").collect()
        each = zip(*sorted(r["sums"] for r in found), strict=True)
        return np.array([math.fsum(v) for v in each]).reshape(len(w) + 1, len(w))

    return newton(sums)


def covering(holders: DataFrame, clean: list[int], odds: Callable[[int, int], float], least: int = COVER) -> list[int]:
    """Of the parts 0, 1, ... that ``holders`` (held: distinct parts of a toxic row) has, a small set that together explains the rows: the
    part with the largest sum of odds over the rows not yet explained is taken, and so on while one explains ``least`` of them and
    is toxic enough on them.

    What a part explains only shrinks. So a part that is the best one of every row it explains is taken before any part it shares
    a row with, whatever else is taken: each round takes all such parts at once, and gives the same set as taking one by one.
    The rows stay with the tasks; what meets the driver are two numbers a part."""
    schema = arrow_schema("part int, n long, best long")
    alive, chosen = np.ones(len(clean), bool), np.zeros(len(clean), bool)
    place = np.zeros(len(clean), np.int64)

    def votes(places: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        live, taken = alive.copy(), chosen.copy()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, best = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
            for b in batches:
                for held in b.column(0).to_pylist():
                    held = np.array(held, np.int64)
                    if len(held) and not taken[held].any():
                        held = held[live[held]]
                        n[held] += 1
                        if places is not None and len(held):
                            best[held[places[held].argmin()]] += 1
            some = n.nonzero()[0]
            yield batch_of(schema, [some.tolist(), n[some].tolist(), best[some].tolist()])

        out = np.zeros((2, len(live)), np.int64)
        for r in holders.select("held").mapInArrow(run, "part int, n long, best long").groupBy("part").agg(F.sum("n").alias("n"), F.sum("best").alias("best")).collect():
            out[:, r["part"]] = r["n"], r["best"]
        return out[0], out[1]

    while True:
        n, _ = votes(None)
        worth = [odds(int(k), clean[p]) if alive[p] and k >= least else 0.0 for p, k in enumerate(n)]
        alive &= (n >= least) & (np.array(worth) >= LEAST_ODDS)
        if not alive.any():
            return [int(p) for p in chosen.nonzero()[0]]
        order = sorted(alive.nonzero()[0], key=lambda p: (n[p] * worth[p], p), reverse=True)
        place[order] = np.arange(len(order))
        n, best = votes(place.copy())
        now = alive & (n == best)
        chosen |= now
        alive &= ~now


def trained(docs: DataFrame, labels: DataFrame, sample_rows: int | None = None) -> Model:
    """Learns from all labelled rows whose labels may be read; with ``sample_rows`` from at most so many, by a hash of the id. Two of three rows
    give the odds, the third the logistic weights; the character model, which knows no labels, is made of all trigrams of all of them. Without toxic rows the model scores every text low.

    The labelled texts are written once to the shared folder; counts, cover and weights are made of sums over all of them."""
    per_id = (labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("label")))
    wanted = per_id if sample_rows is None else per_id.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # Only texts that a filter of the labelled ids lets through are dealt by id, and always, so that the work grows with the labelled rows.
    likely = split_by_ids(id_and_text(docs).filter(~held_out(F.col("doc_id"))), wanted, "doc_id")[1]
    sample = written(likely.join(wanted.hint("shuffle_merge"), "doc_id").select(
        "text", "label", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0).alias("second")), "toxicity-sample")
    schema = arrow_schema("kind string, part string, toxic long, clean long")

    def counts(rows: DataFrame, **what) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for found in counted(batches, **what):
                yield batch_of(schema, found)

        return rows.select("text", "label").mapInArrow(run, "kind string, part string, toxic long, clean long")

    totals = {r["label"]: r["count"] for r in sample.filter("not second").groupBy("label").count().collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic:
        return Model()
    prior = n_toxic / (n_toxic + n_clean)
    # Only parts that enough toxic rows hold can be taken: those are told first, and of clean rows no others are counted.
    held = written(counts(sample.filter("not second and label <> 0"), grams=False).groupBy("part").agg(F.sum("toxic").alias("toxic")).filter(F.col("toxic") >= COVER),
                   "toxicity-parts")
    told = written(counts(sample.filter("not second and label = 0"), wanted=among(held)).unionByName(
        counts(sample.filter("second or label <> 0"), grams_only=True)).groupBy("kind", "part").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxicity-counts")
    found = held.join(told.filter("kind = 'part'").select("part", "clean"), "part", "left").select("part", "toxic", F.coalesce("clean", F.lit(0)).alias("clean"))

    def odds(toxic: int, clean: int) -> float:
        if prior == 1:
            return 0.0
        return math.log((toxic + PRIOR * prior) / (clean + PRIOR * (1 - prior)) * (1 - prior) / prior)

    ratio = F.col("toxic") / (F.col("clean") + PRIOR)
    strong = (F.col("toxic") + PRIOR * prior) * (1 - prior) >= (F.col("clean") + PRIOR * (1 - prior)) * prior * math.exp(LEAST_ODDS)
    candidates = sorted(((len(r["part"]), r["part"], r["toxic"], r["clean"]) for r in found
                         .filter((ratio > prior) & strong).orderBy(F.desc(ratio), "part").limit(LEXICON_PARTS).collect()))  # of equal sums the longer part is taken: it stands later
    numbers = {part: k for k, (_, part, _, _) in enumerate(candidates)}
    hit_schema = arrow_schema("held array<int>")

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted({numbers[p] for w in set(tokens(t.as_py())) for p in parts(w) if p in numbers}) for t in b.column(0)]
            yield batch_of(hit_schema, [[x for x in found if x]])

    holders = written(sample.filter("not second and label = 1").select("text").mapInArrow(holding, "held array<int>"), "toxicity-holders")
    weighed = {part: odds(toxic, clean) for _, part, toxic, clean in candidates}
    chosen = {candidates[k][1] for k in covering(holders, [c for *_, c in candidates], odds)}
    lexicon = {part: v for part, v in weighed.items() if v >= SURE_ODDS or part in chosen}
    grams = told.filter("kind = 'gram'").select("part", (F.col("toxic") + F.col("clean")).alias("n")).collect()
    model = Model(lexicon, trigram_model({r["part"]: r["n"] for r in grams}))
    x_schema = arrow_schema("label int, x array<double>")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(CACHE)
        for b in batches:
            yield batch_of(x_schema, [b.column(1).to_pylist(), [model.features(t.as_py(), memo) for t in b.column(0)]])

    rows = written(sample.filter("second").select("text", "label").mapInArrow(measure, "label int, x array<double>"), "toxicity-features")
    if {r["label"] for r in rows.select("label").distinct().collect()} >= {0, 1}:
        return Model(model.odds, model.trigrams, fitted(rows))
    return Model(model.odds, model.trigrams, (-6.0, 1.0, 0.5, 0.0))


def trigram_model(counts: dict[str, int]) -> dict[str, float]:
    """Log probabilities of a character after two others, from counts, with a little taken off the seen ones."""
    totals: Counter = Counter()
    for g, n in counts.items():
        totals[g[:2]] += n
    return {g: math.log(n / (totals[g[:2]] + 1)) for g, n in counts.items()}


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row, from one pass without a shuffle.

    Only the text goes into the score. Null and empty texts have the score of a text without words. Repeated
    rows get the same answer each; a null id stays null and counts as held out; other columns are not read."""
    ddl = "doc_id long, held_out boolean, score double, predicted int"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(CACHE)
        for b in batches:
            if b.num_rows:
                x = np.array([model.features(t.as_py(), memo) for t in b.column(2)], float)
                score = model.score(x).tolist()
                yield batch_of(schema, [b.column(0).to_pylist(), b.column(1).to_pylist(), score, [int(s >= threshold) for s in score]])

    return id_and_text(docs, id_col, text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, ddl)


def clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns as they were, in one pass without a join."""
    def decide() -> Callable[[list[str]], list[bool]]:
        memo = Memo(CACHE)
        return lambda texts: (model.score(np.array([model.features(t, memo) for t in texts], float)) < threshold).tolist()

    return filtered(docs, text_col, decide)
