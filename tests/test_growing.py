"""Files that grow: slices, byte ranges, and streams that go on where they stopped."""

import json

import pytest

from crowdgauge import schemas as S
from crowdgauge.sources import growing as G
from crowdgauge.sources import landing as LD

TEXT = b"one\ntwo \xe4\xb8\xad\r\n\nfour\xff\n" + b"x" * 50 + b"\nlast without end"


@pytest.mark.parametrize("split", [1, 2, 3, 7, 1000])
def test_ranges_give_each_line_once(tmp_path, split):
    (tmp_path / "a.log").write_bytes(TEXT)
    store, root = G.opened(str(tmp_path))
    path, size = next(iter(G.sizes(str(tmp_path), "*.log").items()))
    got = [x for r in G.ranges(path, 0, size, split) for x in G.lines_in(store, r)]
    want, at = [], 0
    for line in TEXT.split(b"\n"):
        want.append((at, line))
        at += len(line) + 1
    assert got == want


def test_slices(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.log").write_bytes(TEXT)
    (tmp_path / "d" / "_hidden.log").write_bytes(TEXT)
    (tmp_path / "d" / "empty.log").write_bytes(b"")
    rows = lambda **k: [(r.start, r.line) for r in G.line_slice(spark, str(tmp_path), "*.log", split_bytes=9, **k).orderBy("start").collect()]
    assert [x for _, x in rows()] == ["one", "two 中", "", "four�", "x" * 50, "last without end"]
    assert rows(start=4)[0] == (4, "two 中") and rows(start=5)[0] == (5, "wo 中")
    assert [x for _, x in rows(tail_bytes=8)] == ["hout end"[:8]]
    assert rows(start=10_000) == []


def note(k, **more):
    return json.dumps({"note_id": k, "title": f"t{k}", "time": 1_700_000_000_000, **more})


def test_a_stream_reads_what_was_appended(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    (folder / "jsonl").mkdir(parents=True)
    one, two = folder / "jsonl" / "search_contents_1.jsonl", folder / "jsonl" / "search_contents_2.jsonl"

    def run():
        stream = G.growing_json(spark, f"file:{folder}", LD.NOTE_FILES, S.LANDING_NOTE, split_bytes=40)
        q = stream.select("note_id", "_bad").writeStream.format("parquet").option("path", str(out)).option(
            "checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.note_id or "bad") for r in spark.read.schema("note_id string, _bad string").parquet(str(out)).collect())

    one.write_text(note("a") + "\n" + note("b")[:20])
    assert run() == ["a"]
    with one.open("a") as f:
        f.write(note("b")[20:] + "\n\n{broken\n" + note("c"))
    two.write_text(note("d") + "\n")
    assert run() == ["a", "b", "bad", "d"]
    assert run() == ["a", "b", "bad", "d"]
    with one.open("a") as f:
        f.write("\n")
    assert run() == ["a", "b", "bad", "c", "d"]
