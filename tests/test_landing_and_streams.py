import json

from pyspark.sql import functions as F

from crowdgauge import schemas as S
from crowdgauge.sources import landing as LD
from crowdgauge.sources.store import CycleTable, KeyedTable, append_by_day, read_window
from crowdgauge.streaming import pipelines as SP

NOW = 1_700_000_000_000
HOUR = 3_600_000


def write(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n\n", encoding="utf-8")


def landed(tmp_path):
    write(tmp_path / "jsonl", "search_contents_1.jsonl", [
        {"note_id": "a", "title": "t", "time": NOW, "liked_count": "1.2万"}, {"note_id": "b", "time": NOW // 1000, "liked_count": 5},
        {"note_id": "old", "time": NOW - 100 * HOUR}, {"title": "no id", "time": NOW}, "{broken"])
    write(tmp_path / "jsonl", "search_contents_2.jsonl", [{"note_id": "a", "title": "later", "time": NOW - HOUR}])
    write(tmp_path / "jsonl", "search_comments_1.jsonl", [
        {"comment_id": "c1", "note_id": "a", "content": "long enough text", "create_time": NOW, "like_count": "10+"},
        {"comment_id": "c2", "note_id": "missing", "content": "x", "create_time": NOW}])


def test_files_to_tables(spark, tmp_path):
    landed(tmp_path)
    n, c = LD.read_notes(spark, str(tmp_path)), LD.read_comments(spark, str(tmp_path))
    rows = {r["note_id"]: r for r in LD.note_rows(n, 3, 72 * HOUR, NOW).collect()}
    assert set(rows) == {"a", "b"} and rows["b"]["publish_time_ms"] == NOW and rows["a"]["title"] == "later"
    assert rows["a"]["publish_time_ms"] == NOW
    notes = LD.note_rows(n, 3, 72 * HOUR, NOW)
    assert [r["comment_id"] for r in LD.comment_rows(c, notes, 3, 72 * HOUR, NOW).collect()] == ["c1"]
    stats = LD.accounting(n, c, notes, 72 * HOUR, NOW).first().asDict()
    assert stats == {"notes_fetched": 4, "notes_fresh": 3, "comments_seen": 2, "comments_fresh": 1, "malformed": 2}
    assert {r["prefix"]: r["lines"] for r in LD.line_counts(spark, str(tmp_path)).collect()}["search_comments"] >= 2


def test_stream_upserts_once_per_batch(spark, tmp_path):
    landed(tmp_path / "in")
    stream = SP.landing_stream(spark, str(tmp_path / "in"), LD.NOTE_FILES, S.LANDING_NOTE, max_files=1)
    table = KeyedTable(spark, str(tmp_path / "table"), "note_id string, title string, seen bigint, publish_time_ms bigint", ["note_id"])

    def prepare(batch):
        good, _ = LD.quarantine(batch, ["note_id"], "time")
        ts = LD.V.normalize_ts("time")
        return good.groupBy("note_id").agg(F.max("title").alias("title"), F.lit(1).cast("bigint").alias("seen"), F.min(ts).alias("publish_time_ms"))

    q = stream.writeStream.foreachBatch(SP.upsert_batches(table, "seen", ["publish_time_ms"], prepare)).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["note_id"] for r in table.read().collect()}
    assert got == {"a", "b", "old"} and len(table.versions()) == 2


def test_snapshots_are_idempotent(spark, tmp_path):
    table = CycleTable(spark, str(tmp_path / "snaps"), S.SNAPSHOTS, ["ticker", "snapped_at_ms"], "snapped_at_ms")
    rows = spark.createDataFrame([("A", 1, 5, 2.0, 1, 1, 0)], S.SNAPSHOTS)
    write = SP.snapshot_batches(table)
    for batch_id in (0, 1, 1):
        write(rows, batch_id)
    assert table.read().count() == 1


def files_of(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k string, v bigint, first bigint", ["k"], buckets=8)
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v bigint, first bigint")
    table.merge(rows(*[(f"k{i}", 1, 1) for i in range(50)]), "v", ["first"], 0)
    before = files_of(tmp_path / "t")
    for _ in range(2):  # a repeated batch changes nothing
        table.merge(rows(("k7", 2, 9), ("new", 2, 9)), "v", ["first"], 1)
    after = files_of(tmp_path / "t")
    assert {k: after[k] for k in before} == before and 1 <= len({k.split("/")[1] for k in after if k.startswith("v1")}) <= 2
    got = {r.k: (r.v, r.first) for r in table.read().collect()}
    assert len(got) == 51 and got["k7"] == (2, 1) and got["new"] == (2, 9) and got["k8"] == (1, 1)
    assert table.read(before=1).count() == 50


def test_cycles_are_appended_once_and_not_rewritten(spark, tmp_path):
    table = CycleTable(spark, str(tmp_path / "snaps"), S.SNAPSHOTS, ["ticker", "snapped_at_ms"], "snapped_at_ms")
    rows = lambda *r: spark.createDataFrame([(t, 5, c, s, 1, 1, 0) for t, c, s in r], S.SNAPSHOTS)
    table.append_absent(rows(("A", 1, 1.0), ("B", 1, 2.0), ("A", 2, 3.0)), 0)
    before = files_of(tmp_path / "snaps")
    table.append_absent(rows(("A", 2, 9.0), ("B", 2, 4.0), ("A", 3, 5.0)), 1)
    table.append_absent(rows(("A", 2, 9.0), ("B", 2, 4.0), ("A", 3, 5.0)), 1)
    after = files_of(tmp_path / "snaps")
    assert {k: after[k] for k in before} == before
    assert sorted((r.ticker, r.snapped_at_ms, r.score) for r in table.read().collect()) == [("A", 1, 1.0), ("A", 2, 3.0), ("A", 3, 5.0), ("B", 1, 2.0), ("B", 2, 4.0)]


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(path))


def appended(stream, root):
    stream.writeStream.format("parquet").option("path", str(root / "out")).option("checkpointLocation", str(root / "progress")).trigger(
        availableNow=True).start().awaitTermination()


def test_a_comment_waits_for_its_note(spark, tmp_path):
    times = lambda rows: [r | {"seen": f"2024-01-01 {r['h']:02}:00:00"} for r in rows]
    schema = "note_id string, comment_id string, h int, seen timestamp"
    (tmp_path / "n").mkdir()

    def run():
        notes, comments = stream_of(spark, tmp_path / "n", schema), stream_of(spark, tmp_path / "c", schema)
        appended(SP.with_late_parents(comments, notes, "seen", "seen", "5 hours").select("comment_id"), tmp_path)
        return sorted(r.comment_id for r in spark.read.schema("comment_id string").parquet(str(tmp_path / "out")).collect())

    one, two = times([{"note_id": "a", "comment_id": "c1", "h": 1}, {"note_id": "b", "comment_id": "c2", "h": 1}]), times([{"note_id": "a", "comment_id": "c3", "h": 2}])
    write(tmp_path / "c", "1.json", one)
    assert run() == []
    parents = times([{"note_id": "a", "h": 3}, {"note_id": "b", "h": 9}])
    write(tmp_path / "n", "1.json", parents)
    assert run() == ["c1"]  # the note of c2 came too late
    write(tmp_path / "c", "2.json", two)
    write(tmp_path / "n", "2.json", parents)
    assert run() == ["c1", "c3"]
    frame = lambda rows: spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    batch = SP.with_late_parents(frame(one + two), frame(parents), "seen", "seen", "5 hours")
    assert sorted(r.comment_id for r in batch.collect()) == ["c1", "c3"]


def test_alarms_keep_their_count_over_a_restart(spark, tmp_path):
    schema = "run_id long, keyword string, line string, start long"
    line = lambda n, start=100: {"run_id": 1, "keyword": "k", "line": "CAPTCHA appeared " * n, "start": start}

    def run():
        appended(SP.marker_alarms(stream_of(spark, tmp_path / "in", schema), threshold=5, since=50), tmp_path)
        return [(r.run_id, r.keyword, r.captchas) for r in spark.read.schema("run_id long, keyword string, captchas long").parquet(str(tmp_path / "out")).collect()]

    write(tmp_path / "in", "1.json", [line(3), line(9, start=10)])
    assert run() == []
    write(tmp_path / "in", "2.json", [line(4), {"run_id": 2, "keyword": "k", "line": "CAPTCHA", "start": 60}])
    assert run() == [(1, "k", 7)]
    write(tmp_path / "in", "3.json", [line(8)])
    assert run() == [(1, "k", 7)]


def test_a_timer_ends_the_state_of_a_run(spark, tmp_path):
    schema = "run_id long, keyword string, line string, seen timestamp"
    line = lambda run, day: {"run_id": run, "keyword": "k", "line": "CAPTCHA appeared " * 3, "seen": f"2024-01-{day:02} 00:00:00"}

    def run():
        appended(SP.marker_alarms(stream_of(spark, tmp_path / "in", schema), threshold=5, time="seen"), tmp_path)
        return spark.read.schema("run_id long, keyword string, captchas long").parquet(str(tmp_path / "out")).count()

    write(tmp_path / "in", "1.json", [line(1, 1)])
    assert run() == 0
    write(tmp_path / "in", "2.json", [line(2, 9)])
    write(tmp_path / "in", "3.json", [line(2, 20)])
    assert run() == 1  # run 2 comes to six; run 1 was let go of meanwhile
    write(tmp_path / "in", "4.json", [line(1, 21)])
    assert run() == 1


def test_streams_without_files_give_empty_tables(spark, tmp_path):
    (tmp_path / "none").mkdir()
    none = spark.readStream.schema("source_keyword string").parquet(str(tmp_path / "none"))
    assert SP.run_available(SP.keyword_counts(none), "none", "complete").collect() == []
    assert SP.run_available(none, "none").collect() == []


def test_day_partitions(spark, tmp_path):
    df = spark.createDataFrame([("x", NOW), ("y", NOW - 72 * HOUR)], "k string, t bigint")
    append_by_day(df, str(tmp_path / "d"), "t")
    got = read_window(spark, str(tmp_path / "d"), "t", NOW - HOUR)
    assert [r["k"] for r in got.collect()] == ["x"]
    assert "PartitionFilters: [isnotnull(day" in got._jdf.queryExecution().executedPlan().toString()


def test_compatibility_forms_are_resolved_at_ingest(spark, tmp_path):
    import json

    from crowdgauge import schemas as S
    from crowdgauge.sources import landing as L

    (tmp_path / "search_contents_1.jsonl").write_text(json.dumps({"note_id": "1", "title": "ten \u338f bag", "desc": "\ufb01ne \u2163", "time": "1700000000000"}) + "\n")
    landed = L.read_jsonl(spark, str(tmp_path), L.NOTE_FILES, S.LANDING_NOTE)
    row = L.note_rows(landed, 1, 10**12, 1_700_000_000_000).first()
    assert (row["title"], row["note_desc"]) == ("ten kg bag", "fine IV")


def test_search_takes_backslashes_and_folds_ascii_only(spark):
    from crowdgauge.functions import text as T

    rows = spark.createDataFrame([("a\\b",), ("A\\B",), ("\u00c9",), ("x",)], "t string")
    assert rows.filter(T.search_match("t", "a\\B")).count() == 2
    assert rows.filter(T.search_match("t", "\u00e9")).count() == 0
