"""Best-fit packing with certificates.

Documents become token ids; only those longer than a sequence are cut. Pieces as long as a sequence are
sequences of their own. The rest are dealt to groups of about ``group_pieces`` pieces by a hash, and each
group is packed by best-fit decreasing. Dual feasible functions give a lower bound of the bins any packing
of the group needs: a group that meets its bound is certified and keeps its well-filled bins. Groups with a gap keep
only their full ones. All other pieces are dealt anew, to fewer groups, and packed again; this ends when none is
left, after a round with one group, or when a round saves nothing.

Only (doc_id, piece, length) rows move, and a group is bounded by ``group_pieces``, whatever the table's size.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, id_and_text, written
from .memo import Memo

CAPACITY = 4_096
GROUP_PIECES = 20_000
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
ROUNDS = 8
TRAILING = ".,;:!?%#$&*|"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class WordEncoder:
    """Token ids as bytes, from a tokenizer that drops white space and never joins across it.

    A text is cut at ASCII white space. Chunks that were met before come from a bounded memory; new ones are
    split into letters and trailing marks, which the tokenizer's pattern keeps apart, and go to the tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.normalizer, self.speller = self.tokenizer.model, self.tokenizer.normalizer, ByteLevel(add_prefix_space=False, use_regex=False)
        self.chunks, self.runs = Memo(80_000), Memo(80_000)

    def ids(self, s: str) -> bytes:
        return array("I", self.tokenizer.encode(s, add_special_tokens=False).ids).tobytes()

    def run(self, s: str) -> bytes:
        """A run of letters or of marks. What is all letters after normalisation is one piece for the tokenizer's pattern, so
        it goes straight to the merges."""
        got = self.runs.get(s)
        if got is None:
            piece = s.lower() if s.isascii() else self.normalizer.normalize_str(s)
            if piece.isalpha():
                spelled = piece if s.isascii() else self.speller.pre_tokenize_str(piece)[0][0]
                got = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
            else:
                got = self.ids(s)
            self.runs.put(s, got)
        return got

    def chunk(self, raw: bytes) -> bytes:
        s = raw.decode("utf-8")
        head = s.rstrip(TRAILING)
        if head.isalpha():
            got = self.run(head)
            return self.chunks.put(raw, got + self.run(s[len(head):]) if len(head) < len(s) else got)
        return self.chunks.put(raw, self.ids(s))

    def encode(self, text: str) -> bytes:
        known = self.chunks.young
        return b"".join([known.get(w) or self.known(w) for w in text.encode("utf-8").split()])

    def known(self, w: bytes) -> bytes:
        got = self.chunks.get(w)
        return self.chunk(w) if got is None else got


def tokenized_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32): the ids of a text and an end id, cut at ``capacity``. ``row``
    tells rows apart that repeat an id. Null and empty texts are the end id alone; a null id stays null; other
    columns are not read."""
    path = tokenizer or default_tokenizer()
    schema = arrow_schema(ddl := "doc_id long, row long, piece int, start long, length long, ids_crc32 long")
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from crowdgauge.llm.memo import held

        encoder = held(("words", path), lambda: WordEncoder(path))
        for b in batches:
            rows = []
            for doc_id, row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                ids = encoder.encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at:at + 4 * capacity]
                    rows.append((doc_id, row, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
            if rows:
                yield batch_of(schema, list(zip(*rows, strict=True)))

    return id_and_text(docs, id_col, text_col).select("doc_id", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(run, ddl)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indexes, best fit over lengths in falling order. Free space is looked up in one bit per size."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits, bins = 0, []
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        open_bits = bits >> n
        if open_bits:
            room = n + (open_bits & -open_bits).bit_length() - 1
            at = free[room].pop()
            if not free[room]:
                bits &= ~(1 << room)
            bins[at].append(k)
        else:
            room, at = capacity, len(bins)
            bins.append([k])
        left = room - n
        if left:
            free[left].append(at)
            bits |= 1 << left
    return bins


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the largest of the total size and of two families of dual feasible functions.

    u_k rounds (k + 1) x / capacity down unless it is whole; the threshold functions count a piece above
    capacity - t as a whole bin and drop those below t."""
    if not len(lengths):
        return 0
    x = lengths.astype(np.int64)
    best = -(-int(x.sum()) // capacity)
    for k in range(1, 101):
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)
        best = max(best, -(-int(value.sum()) // (k * capacity)))
    sizes = np.sort(x)
    sums = np.concatenate([[0], np.cumsum(sizes)])
    for t in np.unique(sizes[sizes <= capacity // 2]):
        low, high = np.searchsorted(sizes, t, "left"), np.searchsorted(sizes, capacity - t, "right")
        middle = int(sums[high] - sums[low])
        best = max(best, len(sizes) - int(high) + -(-middle // capacity))
    return best


PIECE = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECE}, grp int, bin int, offset long, room long, gap int"


def packed_groups(pieces: DataFrame, groups: int, seed: int, capacity: int) -> DataFrame:
    """Each group packed by best fit: a piece's group, bin and place, the free room of the bin, and how many bins
    the group has above its lower bound."""
    schema = arrow_schema(PLACED)

    def pack(group: pa.Table) -> pa.Table:
        group = group.take(pa.array(np.lexsort([group[c].to_numpy() for c in ("piece", "row")])))
        lengths, n = group["length"].to_numpy(), group.num_rows
        bins = best_fit(lengths, capacity)
        gap = len(bins) - lower_bound(lengths, capacity)
        bin_of, offset, room = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for b, members in enumerate(bins):
            ends = np.cumsum(lengths[members])
            bin_of[members], offset[members], room[members] = b, ends - lengths[members], capacity - ends[-1]
        made = [*(group[f.name].combine_chunks() for f in schema if f.name in group.column_names),
                *map(pa.array, (bin_of, offset, room, np.full(n, gap, np.int32)))]
        return pa.Table.from_arrays(made, schema=schema)

    grp = F.pmod(F.xxhash64("row", "piece", F.lit(seed)), F.lit(groups)).cast("int")
    return pieces.withColumn("grp", grp).groupBy("grp").applyInArrow(pack, PLACED)


def best_fit_packing(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Adds (sequence_id, offset) to the columns of PIECE; ``pieces`` should be a written table, it is read several times.

    Sequence ids are any numbers, offsets run without gap from 0. Whether a repacking is taken is decided by its
    number of bins; else the packing before it stays. An empty table packs to an empty table."""
    columns = [x.split()[0] for x in PIECE.split(", ")]
    full = pieces.filter(F.col("length") >= capacity).select(
        *columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def placed(packed: DataFrame, turn: int) -> DataFrame:
        number = F.lit(turn).cast("long") * (1 << 58) + F.col("grp").cast("long") * (1 << 24) + F.col("bin")
        return packed.select(*columns, number.alias("sequence_id"), "offset")

    def measured(packed: DataFrame) -> tuple[int, int]:
        per_bin = packed.groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("n"))
        row = per_bin.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("bins")).first()
        return row["n"], row["bins"]

    done, pool, old = full, pieces.filter(F.col("length") < capacity).select(*columns), None
    left, bins = pool.count(), None
    for turn in range(rounds):
        if not left:
            break
        groups = -(-left // group_pieces)
        packed = written(packed_groups(pool, groups, turn, capacity), "packed")
        if old is not None and measured(packed)[1] >= bins:
            return done.unionByName(old)
        if groups == 1 or turn == rounds - 1:
            return done.unionByName(placed(packed, turn))
        # Of a group with a gap all bins with room go on; a certified group offers its roomy bins, so that what
        # each group rounds up is made good among groups.
        open_bins = F.when(F.col("gap") > 0, F.col("room") > 0).otherwise(F.col("room") >= capacity // 8)
        done = done.unionByName(placed(packed.filter(~open_bins), turn))
        pool = packed.filter(open_bins)
        old = placed(pool, turn)
        left, bins = measured(pool)
        pool = pool.select(*columns)
    return done


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): all documents in as few sequences as this packing
    finds. Tokenised pieces are written to the shared folder first, so texts are read once."""
    pieces = written(tokenized_pieces(docs, tokenizer, capacity, id_col, text_col), "pieces")
    return best_fit_packing(pieces, capacity).drop("row")
