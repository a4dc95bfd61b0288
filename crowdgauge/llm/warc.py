"""WARC archives: write pages as records, read archives back, put segmented records together.

Writing uses Spark's text writer with the record end of the format, two CRLF, as line separator: every
row is one record, every file an archive. A block longer than ``segment_bytes`` is written as a first
segment and ``continuation`` records, which carry the origin's id, a segment number and, on the last, the
total length. Blocks are HTTP messages in chunked transfer framing. Pages that repeat another page's
payload become ``revisit`` records that hold headers only.

Reading walks the bytes of each archive by the records' lengths, so payloads may hold anything. Whole
records are decoded where they are read; segments meet by origin id in groups as small as one record, are
ordered by number, and count only if numbers run from 1 without gap and the lengths add up.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, fresh_path

CRLF = "\r\n"
GZIP = b"\x1f\x8b"
END = CRLF + CRLF
SEGMENT_BYTES = 32_768
CHUNK_BYTES = 8_192
RECORDS_PER_FILE = 1_024
REVISIT_FROM_BYTES = 100
ID = "urn:page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, refers_to long, digest string, problem string, payload binary"


def cut(data: bytes, size: int) -> list[bytes]:
    """Pieces of at most ``size`` bytes that never end inside a UTF-8 character; one empty piece for none."""
    pieces, at = [], 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        if end <= at:
            raise ValueError("a piece must have room for one character")
        pieces.append(data[at:end])
        at = end
    return pieces or [b""]


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing."""
    body = b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in cut(payload, size) if c)
    return body + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; raises ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        out.append(body[at:at + size])
        if len(out[-1]) != size or body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut off")
        at += size + 2


def header(fields: dict[str, object], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}{CRLF}" for k, v in fields.items() if v is not None)
    return f"WARC/1.1{CRLF}{lines}Content-Length: {len(block)}{END}".encode() + block


def field(value) -> str | None:
    """A value fit for one header line."""
    return None if value is None else "".join(c if c >= " " else "%%%02X" % ord(c) for c in str(value)).strip()


def records_of(page_id, url, payload: bytes, digest: str, first, row: str, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page, without the closing CRLFs; ``first`` is the page it repeats, or None. ``row``
    tells rows apart that repeat a page id, so their segments don't mix."""
    name = f"<{ID}{'' if page_id is None else page_id}>"
    common = {"WARC-Target-URI": field(url), "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http;msgtype=response"}
    if first is not None:
        yield header({"WARC-Type": "revisit", "WARC-Record-ID": name, "WARC-Profile": REVISIT_PROFILE,
                      "WARC-Refers-To": f"<{ID}{first}>"} | common, b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    segments = cut(block, segment_bytes)
    many = len(segments) > 1
    name = f"{name[:-1]}/{row}>" if many else name
    yield header({"WARC-Type": "response", "WARC-Record-ID": name, "WARC-Segment-Number": 1 if many else None} | common, segments[0])
    for k, segment in enumerate(segments[1:], 2):
        total = len(block) if k == len(segments) else None
        yield header({"WARC-Type": "continuation", "WARC-Record-ID": f"{name[:-1]}:{k}>", "WARC-Segment-Origin-ID": name,
                      "WARC-Segment-Number": k, "WARC-Segment-Total-Length": total}, segment)


def payloads(pages: DataFrame, id_col: str, url_col: str | None, html_col: str) -> DataFrame:
    """(page_id, url, html, digest, size); null html is empty."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    url = F.col(url_col) if url_col in pages.columns else F.lit(None)
    return pages.select(F.col(id_col).cast("long").alias("page_id"), url.cast("string").alias("url"), html.alias("html"),
                        F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("size"))


def with_first(rows: DataFrame, least: int) -> DataFrame:
    """Adds ``first``: the smallest page id with the same payload if that is another page and the payload has
    at least ``least`` bytes. The digests that repeat are folded before the shuffle and looked up by an
    equi-join of narrow rows."""
    narrow = rows.filter((F.col("size") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    firsts = (narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
              .filter("n > 1").select("digest", "first"))
    later = narrow.join(firsts, "digest").filter("page_id <> first").distinct()
    return rows.join(later, ["page_id", "digest"], "left")


def write_warc(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str | None = "url", html_col: str = "html",
               revisit_from: int = REVISIT_FROM_BYTES, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES,
               records_per_file: int = RECORDS_PER_FILE, compression: str = "gzip") -> str:
    """Writes one archive folder and returns its path.

    Null html is an empty payload, a null url leaves its header line out, control characters in it are
    percent-encoded. Pages with a null id are written as responses. ``records_per_file`` bounds a file,
    which is read back as one value."""
    path = path or fresh_path(pages.sparkSession, "warc")
    schema = arrow_schema("value string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for b in batches:
            out = []
            for page_id, url, html, digest, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                row += 1
                out += records_of(page_id, url, html.encode(), digest, first, f"{part}-{row}", segment_bytes, chunk_bytes)
            yield batch_of(schema, [[r.decode() for r in out]])

    rows = with_first(payloads(pages, id_col, url_col, html_col), revisit_from)
    (rows.select("page_id", "url", "html", "digest", "first").mapInArrow(run, "value string")
     .write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).option("compression", compression).text(path))
    return path


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, by the lengths the headers give."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record starts at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        yield fields, data[end + 4:end + 4 + size]
        at = end + 4 + size
        if data[at:at + 4] not in (b"\r\n\r\n", b""):
            raise ValueError(f"the record before byte {at} has another length than it says")
        at += 4


def page_of(name: str | None):
    digits = (name or "").strip("<>").removeprefix(ID).partition("/")[0]
    return int(digits) if digits else None


def decoded(block: bytes) -> bytes:
    """The payload of an HTTP message, transfer framing undone."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def whole(fields: dict[str, str], block: bytes, problem: str | None = None) -> tuple:
    """One row of RECORD; a record that can't be decoded, or whose payload has another digest, says so."""
    import hashlib

    kind, digest, payload = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha256:"), None
    if kind == "response" and problem is None:
        try:
            payload = decoded(block)
            if hashlib.sha256(payload).hexdigest() != digest:
                problem = "digest"
        except ValueError:
            problem = "framing"
    return (page_of(fields.get("warc-record-id")), fields.get("warc-target-uri"), kind, page_of(fields.get("warc-refers-to")),
            digest, problem, payload)


def joined(segments: list[tuple]) -> tuple:
    """The record that segments (number, total, fields, block) of one origin make: numbers from 1 without
    gap, lengths that add up. Segments read twice count once."""
    segments = [v for _, v in sorted({s[0]: s for s in segments}.items())]
    block = b"".join(s[3] for s in segments)
    fields = next((dict(s[2]) for s in segments if s[2] is not None), {})
    total = max((s[1] for s in segments if s[1] is not None), default=None)
    sound = fields and [s[0] for s in segments] == list(range(1, len(segments) + 1)) and total == len(block)
    return whole(fields, block, None if sound else "segments")


PART = "origin string, number int, total long, fields map<string,string>, block binary"


def part_of(fields: dict[str, str], block: bytes) -> tuple:
    """One row of PART: ``origin`` is null for a record in one piece, ``fields`` for a continuation."""
    number = fields.get("warc-segment-number")
    if number is None:
        return None, None, None, list(fields.items()), block
    if fields["warc-type"] != "continuation":
        return fields["warc-record-id"], int(number), None, list(fields.items()), block
    total = fields.get("warc-segment-total-length")
    return fields["warc-segment-origin-id"], int(number), None if total is None else int(total), None, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, digest, problem, payload): one row per response and revisit.

    Segments are put together; ``problem`` is null, or says why a record has no payload to trust: its
    segments are missing or too long (``segments``), the framing is broken (``framing``) or the bytes
    don't fit the digest (``digest``). Empty archives have no rows."""
    part_schema, record_schema = arrow_schema(PART), arrow_schema(RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                content = content.as_py()
                found = parse(gzip.decompress(content) if content[:2] == GZIP else content)
                while rows := [part_of(*r) for r in islice(found, 256)]:
                    yield batch_of(part_schema, list(zip(*rows, strict=True)))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows = [whole(dict(f), d) for f, d in zip(*(c.to_pylist() for c in b.columns), strict=True)]
                yield batch_of(record_schema, list(zip(*rows, strict=True)))

    def gather(group: pa.Table) -> pa.Table:
        rows = zip(*(group[c].to_pylist() for c in ("number", "total", "fields", "block")), strict=True)
        return pa.Table.from_batches([batch_of(record_schema, [[x] for x in joined(list(rows))])])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    parts = files.mapInArrow(run, PART)
    single = parts.filter("origin is null").select("fields", "block").mapInArrow(finish, RECORD)
    pieces = parts.filter("origin is not null").groupBy("origin").applyInArrow(gather, RECORD)
    return single.unionByName(pieces)


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits take the length from the
    response they name, by an equi-join of narrow rows; it is null if that response is not there."""
    size = F.octet_length("payload").cast("long")
    narrow = records.select("page_id", size.alias("size"), "digest", "record_type", "refers_to")
    origin = narrow.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("size").alias("origin_size")).distinct()
    return narrow.join(origin, "refers_to", "left").select(
        "page_id", F.coalesce("size", "origin_size").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        "record_type", "refers_to")
