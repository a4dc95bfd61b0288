"""Lines of files that grow: a data source whose stream goes on in a file where it stopped.

Spark's own file source reads each file once, so lines appended to a file that was seen are never read. Here the offset of a stream is
the number of bytes read of each file; a batch covers what was appended since, in byte ranges that are read by as many tasks. A line that
is not finished yet waits for its end. Read as a batch the source gives a slice of each file: from a start offset, or the last bytes.

Files are read through pyarrow's file systems, so folders may be local, in HDFS or in an object store."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, start bigint, line string"
SPLIT_BYTES, CHUNK = 32 << 20, 1 << 20


def opened(path: str):
    """(file system, path in it) of a folder or file given as Spark is given one."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if colon and not rest.startswith("//"):
        path = f"{scheme}://{rest}"
    return fs.FileSystem.from_uri(path)


def sizes(path: str, glob: str) -> dict[str, int]:
    """Bytes of each file below a folder whose name fits; hidden files and folders are none."""
    from pyarrow import fs

    store, root = opened(path)
    found = store.get_file_info(root)
    listed = [found] if found.is_file else store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    below = len(root.rstrip("/")) + 1
    return {x.path: x.size for x in listed if x.is_file and fnmatch(x.base_name, glob)
            and not any(p[:1] in "._" for p in x.path[below:].split("/") if p)}


def last_line_end(store, path: str, low: int, size: int) -> int:
    """The place after the last newline before ``size``, or ``low`` if there is none since then."""
    with store.open_input_file(path) as f:
        at = size
        while at > low:
            start = max(low, at - CHUNK)
            f.seek(start)
            found = f.read(at - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            at = start
    return low


@dataclass
class Range(InputPartition):
    """Lines that start in [start, stop) of a file; nothing from ``end`` on is read. ``fresh`` says that a line starts at ``start``."""

    path: str
    start: int
    stop: int
    end: int
    fresh: bool


def ranges(path: str, start: int, end: int, split: int) -> list[Range]:
    return [Range(path, a, min(a + split, end), end, a == start) for a in range(start, end, split)]


def lines_in(store, r: Range) -> Iterator[tuple[int, bytes]]:
    """(start, line) of a range; the last line of the file may lack its newline."""
    with store.open_input_file(r.path) as f:
        place = r.start if r.fresh else r.start - 1
        f.seek(place)
        rest, skip = b"", not r.fresh
        while place + len(rest) < r.end:
            got = f.read(min(CHUNK, r.end - place - len(rest)))
            if not got:
                break
            *lines, rest = (rest + got).split(b"\n")
            for line in lines:
                if not skip:
                    if place >= r.stop:
                        return
                    yield place, line
                skip = False
                place += len(line) + 1
        if rest and not skip and place < r.stop:
            yield place, rest


def batches(uri: str, r: Range):
    """Arrow batches of SCHEMA. Bytes that are no UTF-8 are replaced."""
    import pyarrow as pa

    store, _ = opened(uri)
    rows, held = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r.path] * len(rows)), pa.array([s for s, _ in rows], pa.int64()),
                                           pa.array([x.removesuffix(b"\r").decode("utf-8", "replace") for _, x in rows])], names=["file", "start", "line"])

    for row in lines_in(store, r):
        rows.append(row)
        held += len(row[1])
        if held >= CHUNK or len(rows) == 5_000:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


class GrowingLines(DataSource):
    """``growing_lines``: options ``path``, ``glob``, ``splitBytes`` and, for a batch, ``start`` or ``tailBytes``."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SliceReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowthReader(self.options)


class _Reader:
    def __init__(self, options):
        self.path, self.glob = options["path"], options.get("glob", "*")
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.start, self.tail = int(options.get("start", 0)), options.get("tailBytes")

    def read(self, partition: Range | None):
        return iter(()) if partition is None else batches(self.path, partition)  # None: there was nothing to divide


class SliceReader(_Reader, DataSourceReader):
    """The slice of each file. One that starts within a line gives the rest of that line, too."""

    def partitions(self) -> list[Range]:
        out = []
        for path, size in sorted(sizes(self.path, self.glob).items()):
            start = self.start if self.tail is None else max(0, size - int(self.tail))
            out += ranges(path, start, size, self.split)
        return out


class GrowthReader(_Reader, DataSourceStreamReader):
    def __init__(self, options):
        super().__init__(options)
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, _ = opened(self.path)
        for path, size in sizes(self.path, self.glob).items():
            low = self.known.get(path, 0)
            if size < low:  # another file under the same name
                low = 0
            self.known[path] = last_line_end(store, path, low, size)
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, to in sorted(end.items()):
            since = start.get(path, 0)
            out += ranges(path, since if since <= to else 0, to, self.split)
        return out


def growing_lines(spark: SparkSession, folder: str, files: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Stream of (file, start, line) of a folder whose files are appended to."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("path", folder).option("glob", files).option("splitBytes", split_bytes).load()


def line_slice(spark: SparkSession, folder: str, files: str = "*", start: int = 0, tail_bytes: int | None = None,
               split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, start, line) of each file from byte ``start`` on, or of its last ``tail_bytes`` bytes."""
    spark.dataSource.register(GrowingLines)
    reader = spark.read.format("growing_lines").option("path", folder).option("glob", files).option("start", start).option("splitBytes", split_bytes)
    return (reader if tail_bytes is None else reader.option("tailBytes", tail_bytes)).load()


def growing_json(spark: SparkSession, folder: str, files: str, schema: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """JSON lines of a folder whose files are appended to; broken lines keep their text in ``_bad``, blank ones are skipped."""
    parsed = F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    lines = growing_lines(spark, folder, files, split_bytes)
    return lines.filter(F.trim("line") != "").select(parsed.alias("r")).select("r.*")
