"""SentencePiece encoding and decoding for merge-type (BPE) models, by a table of prefixes.

In a merge-type model every prefix of a word has one encoding, so it has one last token. An automaton over the
vocabulary gives the tokens that end at each place; the last token of a prefix is the one that is compatible with the
last token of the prefix before it, which two tokens are if encoding their joint text gives back those two.
The table is filled from left to right, and the ids are read off it from right to left. Work per character is
bounded by the tokens that end there.

Compatibility is decided on the tokens' merge trees: walking in from the seam, the pieces that touch are
tried in the order in which they would be merged away; two tokens clash if some touching pair would have merged
across the seam first.

A text is cut where no vocabulary piece holds the two characters next to each other, for merges never reach over
such a place. Characters outside the vocabulary become byte tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_schema, batch_of, id_and_text
from .memo import Memo

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
NORMAL, BYTE = 1, 6  # fixed values: piece types of the model format
MERGES = 2  # fixed value: the model type of merge-type models


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class PieceTable:
    """Vocabulary, merge trees and automaton of one model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != MERGES or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix \
                or not spec.escape_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError("not a merge-type model with byte fallback, plain text and a dummy prefix")
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos = self.processor.bos_id(), self.processor.eos_id()
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        # Merges are done by falling score; of equal scores the leftmost pair comes first.
        self.rank = {p.piece: -p.score for p in proto.pieces if p.type == NORMAL}
        self.joins = {(a, b) for piece in self.ids for a, b in zip(piece, piece[1:])}
        self.split: dict[str, tuple[str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) == 1 or self.grown(piece):
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.right_edges: dict[str, list[tuple[str, float, float]]] = {}
        self.left_edges: dict[str, list[tuple[str, float, float]]] = {}
        self.pairs, self.words = Memo(1_000_000), Memo(250_000)
        self.chunks = Memo(250_000)

    def grown(self, piece: str) -> bool:
        """Merges the characters of a vocabulary piece and notes its last merge; False if merging ends elsewhere."""
        parts, rank = list(piece), self.rank
        while len(parts) > 1:
            best = min((rank.get(parts[k] + parts[k + 1], np.inf), k) for k in range(len(parts) - 1))
            if best[0] == np.inf:
                return False
            k = best[1]
            if len(parts) == 2:
                self.split[piece] = (parts[0], parts[1])
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return True

    def edge(self, piece: str, side: int) -> list[tuple[str, float, float]]:
        """(part, born, gone) of the parts of a token that touch its end on that side, from the character up: each is
        there from its own merge to the next one's."""
        chain = [piece]
        while chain[-1] in self.split:
            chain.append(self.split[chain[-1]][side])
        chain.reverse()
        born = [-np.inf, *(self.rank[p] for p in chain[1:])]
        return list(zip(chain, born, [*born[1:], np.inf]))

    def compatible(self, left: str, right: str) -> bool:
        """Whether the encoding of the joint text is these two tokens."""
        key = (left, right)
        got = self.pairs.get(key)
        if got is None:
            got = self.pairs.put(key, self.seam_holds(left, right))
        return got

    def seam_holds(self, left: str, right: str) -> bool:
        a = self.right_edges.get(left) or self.right_edges.setdefault(left, self.edge(left, 1))
        b = self.left_edges.get(right) or self.left_edges.setdefault(right, self.edge(right, 0))
        i = j = 0
        while True:
            (x, _, x_gone), (y, _, y_gone) = a[i], b[j]
            r = self.rank.get(x + y)
            # A merge inside the left token lies further left and wins a tie, one inside the right token loses it.
            if r is not None and r < x_gone and r <= y_gone:
                return False
            if x_gone == np.inf and y_gone == np.inf:
                return True
            if x_gone <= y_gone:
                i += 1
            else:
                j += 1

    def word(self, s: str) -> list[int]:
        """Ids of a stretch of vocabulary characters, by the prefix table."""
        last: list[str | None] = [None] * (len(s) + 1)
        for end, piece in self.automaton.iter(s):
            end += 1
            if last[end] is None:
                start = end - len(piece)
                if start == 0 or last[start] is not None and self.compatible(last[start], piece):
                    last[end] = piece
        out, at = [], len(s)
        while at:
            piece = last[at]
            if piece is None:
                raise ValueError(f"no encoding of {s!r}")
            out.append(self.ids[piece])
            at -= len(piece)
        return out[::-1]

    def stretch(self, s: str) -> bytes:
        got = self.words.get(s)
        if got is None:
            ids = self.word(s) if s[0] in self.ids else [self.byte_ids[x] for x in s.encode()]
            got = self.words.put(s, np.array(ids, "<u4").tobytes())
        return got

    def chunk(self, s: str) -> bytes:
        """Ids of a chunk, cut where no vocabulary piece joins two characters."""
        cuts = [0, *(k for k in range(1, len(s)) if (s[k - 1], s[k]) not in self.joins), len(s)]
        return self.chunks.put(s, b"".join(self.stretch(s[a:b]) for a, b in zip(cuts, cuts[1:])))

    def encode(self, text: str) -> bytes:
        """Ids with begin and end, little-endian 32-bit. Spaces become the piece mark, and one is put before the text."""
        begin, end = np.array([self.bos], "<u4").tobytes(), np.array([self.eos], "<u4").tobytes()
        if not text:
            return begin + end
        known = self.chunks.young
        return b"".join([begin, *[known.get(w) or self.known(w) for w in CHUNKS.findall(SPACE + text.replace(" ", SPACE))], end])

    def known(self, w: str) -> bytes:
        got = self.chunks.get(w)
        return self.chunk(w) if got is None else got


# A run of piece marks with what follows up to the next mark or line end, or line ends.
CHUNKS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n+")


def encode_pieces(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): ids as little-endian 32-bit integers with begin and end, and what they decode to.

    Null and empty texts are begin and end alone. Repeated rows are encoded each; a null id stays null; other columns
    are not read; no rows in, no rows out."""
    return _mapped(docs, model, id_col, text_col, "doc_id long, ids binary, decoded string", lambda ids, decoded: (ids, decoded))


def piece_digests(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encode_pieces``, digested where they are made."""
    import hashlib

    def digests(ids: bytes, decoded: str) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    return _mapped(docs, model, id_col, text_col, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def _mapped(docs: DataFrame, model: str | None, id_col: str, text_col: str, ddl: str, row) -> DataFrame:
    path, schema = model or default_model(), arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from crowdgauge.llm.memo import held

        table = held(("pieces", path), lambda: PieceTable(path))
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = table.encode(text.as_py())
                rows.append((doc_id, *row(ids, table.processor.decode(np.frombuffer(ids, "<u4").tolist()))))
            if rows:
                yield batch_of(schema, list(zip(*rows, strict=True)))

    return id_and_text(docs, id_col, text_col).mapInArrow(run, ddl)
