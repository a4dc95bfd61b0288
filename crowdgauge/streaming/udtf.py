"""Ad-hoc matching as table functions. The batch path is ``operators.matching``."""

import re
import string
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import LATIN_TERM
from ..operators.dictionary import MAX_INLINE_TERMS, Dictionary, match_terms_of

WORD_CHARS = frozenset(string.digits + string.ascii_lowercase)
SYMBOL_CHARS = frozenset(string.digits + string.ascii_letters)
MENTION_COLUMNS = ["ticker", "source_type", "source_id", "note_id", "matched_alias", "match_basis", "content_time_ms"]


def register_match_entities(spark: SparkSession, terms, name: str = "match_entities"):
    """Register ``match_entities(text)`` giving (ticker, alias) rows for the given (ticker, alias)
    pairs, by the same boundary rule: Latin names must not touch letters or digits."""
    pairs = [(t, a, a.lower()) for t, a in terms if a]

    class MatchEntities:
        def eval(self, text: str):
            import re

            low = (text or "").lower()
            for ticker, alias, term in pairs:
                if term not in low:
                    continue
                latin = re.fullmatch(r"[0-9a-z&.\- ]+", term)
                if not latin or re.search(rf"(?<![0-9a-z]){re.escape(term)}(?![0-9a-z])", low):
                    yield ticker, alias

    fn = F.udtf(MatchEntities, returnType="ticker string, alias string")
    spark.udtf.register(name, fn)
    return fn


def register_match_mentions(spark: SparkSession, dictionary: Dictionary, tracked: DataFrame | None = None,
                            name: str = "match_mentions", limit: int = MAX_INLINE_TERMS):
    """Register ``match_mentions(TABLE(texts))``: the mentions ``operators.matching.extract`` finds, as an Arrow table function.

    ``texts`` has source_type, source_id, note_id, text, content_time_ms and targeted; a batch of it is matched where it lies, by one
    automaton over the terms and one over the symbols, so it can be called on any table or stream without a shuffle. The
    function carries its dictionary, of at most ``limit`` terms and traps each; a larger one is an error and needs ``extract``.
    Null texts name nothing."""
    terms = [tuple(r) for r in match_terms_of(dictionary, tracked).select(
        "kind", "term", "ticker", "alias", "ord", "collision", "supersedes").limit(limit + 1).collect()]
    traps = [r["p"] for r in dictionary.traps.orderBy("ord").select(F.lower("phrase").alias("p")).limit(limit + 1).collect() if r["p"]]
    if max(len(terms), len(traps)) > limit:
        raise ValueError(f"more than {limit} terms or traps: use operators.matching.extract")
    strengths, latin = dict(K.STRENGTH), LATIN_TERM

    class MatchMentions:
        def __init__(self):
            import ahocorasick

            self.words, self.symbols = ahocorasick.Automaton(), ahocorasick.Automaton()
            held: dict = {}
            for row in terms:
                held.setdefault((row[0] == "symbol", row[1]), []).append(row)
            for (symbol, term), rows in held.items():
                (self.symbols if symbol else self.words).add_word(term, (term, bool(re.search(latin, term)), rows))
            for automaton in (self.words, self.symbols):
                automaton.make_automaton()

        def found(self, raw: str, low: str) -> list:
            """The dictionary rows a text holds, by the boundary rule; of symbols at one place the longest."""
            rows: dict = {}
            if len(self.words):
                for end, (term, bounded, of_term) in self.words.iter(low):
                    if term not in rows and not (bounded and touches(low, end - len(term) + 1, end + 1, WORD_CHARS)):
                        rows[term] = of_term
            places = []
            if len(self.symbols):
                places = [(end - len(term) + 1, end + 1, of_term) for end, (term, _, of_term) in self.symbols.iter(raw)
                          if not touches(raw, end - len(term) + 1, end + 1, SYMBOL_CHARS)]
            places.sort(key=lambda p: (p[0], -p[1]))
            out, reach = [r for of_term in rows.values() for r in of_term], -1
            for _, end, of_term in places:
                if end > reach:  # not inside one that started at or before it
                    out += [r for r in of_term if r not in out]
                    reach = end
            return out

        def mentions(self, text: str, targeted: str | None) -> list:
            raw = unicodedata.normalize("NFKC", text)
            low = raw.lower()
            for trap in traps:
                low = low.replace(trap, "\x00" * len(trap))
            rows = self.found(raw, low)
            ctx = any(r[0] == "context" for r in rows)
            best: dict = {}
            for kind, _, ticker, alias, place, collision, supersedes in rows:
                if kind == "context":
                    continue
                if kind == "safe":
                    basis = "safe_alias"
                elif kind == "symbol" and (ctx or not collision):
                    basis = "ticker_symbol"
                elif kind == "ambiguous" and ctx:
                    basis = "alias+context"
                elif ctx or targeted == ticker:
                    basis = "targeted_search"
                else:
                    continue
                rank = (-strengths[basis], place, alias)
                if ticker not in best or rank < best[ticker][0]:
                    best[ticker] = (rank, alias, basis, supersedes or [])
            gone = {t for *_, supersedes in best.values() for t in supersedes}
            return [(t, alias, basis) for t, (_, alias, basis, _) in best.items() if t not in gone]

        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            out, at = [], []
            for i, (text, targeted) in enumerate(zip(batch.column("text").to_pylist(), batch.column("targeted").to_pylist(), strict=True)):
                here = self.mentions(text, targeted) if text else []
                out += here
                at += [i] * len(here)
            same = {c: batch.column(c).take(pa.array(at, pa.int64())) for c in ("source_type", "source_id", "note_id", "content_time_ms")}
            told = {c: pa.array([m[k] for m in out], pa.string()) for k, c in enumerate(("ticker", "matched_alias", "match_basis"))}
            columns = {**same, **told}
            yield pa.RecordBatch.from_arrays([columns[c] for c in MENTION_COLUMNS], names=MENTION_COLUMNS)

    fn = F.arrow_udtf(MatchMentions, returnType=", ".join(f"{c} {'bigint' if c == 'content_time_ms' else 'string'}" for c in MENTION_COLUMNS))
    spark.udtf.register(name, fn)
    return fn


def touches(text: str, start: int, end: int, chars: frozenset) -> bool:
    """Does a place stand against one of the characters on either side?"""
    return start > 0 and text[start - 1] in chars or end < len(text) and text[end] in chars
