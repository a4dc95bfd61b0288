import random

from pyspark.sql import functions as F

from crowdgauge.operators import boards, dedup, ledger, quotes, ratings, scoreboard, tables, trend
from crowdgauge.operators.asof import asof_join
from crowdgauge.session import small_table


def test_near_pairs_recall_is_exact_even_in_large_groups(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(30)]
    codes = set()
    for b in base:
        for _ in range(6):
            x = b
            for bit in rnd.sample(range(64), rnd.randint(0, 5)):
                x ^= 1 << bit
            codes.add(x - (1 << 64) if x >= 1 << 63 else x)
    codes = sorted(codes)
    want = {(a, b) for i, a in enumerate(codes) for b in codes[i + 1:] if bin((a ^ b) & (2**64 - 1)).count("1") <= 6}
    df = small_table(spark, [(c,) for c in codes] + [(0,)], "simhash bigint")
    for limit in (2000, 2):
        got = {tuple(r) for r in dedup.near_pairs(df, 6, group_limit=limit).collect()}
        assert got == want


def test_components_are_single_linkage(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, j) for j in range(101, 160)] + [(rnd.randint(200, 240), rnd.randint(241, 260)) for _ in range(40)]
    got = {r["node"]: r["root"] for r in dedup.connected_components(small_table(spark, edges, "a bigint, b bigint")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    assert got == {n: find(n) for n in list(parent)}


def test_trend_labels(spark):
    rows = [("A", 1, 10.0), ("B", 1, 10.0), ("C", 1, 1.0), ("E", 1, 9.0), ("A", 2, 14.0), ("B", 2, 7.0), ("C", 2, 2.0), ("D", 2, 3.0)]
    s = small_table(spark, rows, "ticker string, snapped_at_ms bigint, score double")
    got = {r["ticker"]: (r["dir"], r["delta_pct"]) for r in trend.compute_trends(s).collect()}
    assert got == {"A": ("up", 40), "B": ("down", -30), "C": ("flat", None), "D": ("new", None)}
    assert trend.compute_trends(s.filter("snapped_at_ms = 1")).count() == 0


def test_asof_matches_brute_force_across_buckets(spark):
    rnd = random.Random(1)
    right = [("k", d, float(d)) for d in sorted(rnd.sample(range(3000), 60))]
    left = [("k", rnd.randint(-50, 3100)) for _ in range(200)] + [("none", 5)]
    r = small_table(spark, right, "k string, day bigint, v double")
    for forward in (False, True):
        for equal in (True, False):
            got = asof_join(small_table(spark, left, "k string, t bigint"), r, ["k"], "t", "day", ["v"], forward=forward, allow_equal=equal, bucket=100)
            for row in got.collect():
                days = [d for k, d, _ in right if k == row["k"] and ((d > row["t"]) if forward else (d < row["t"]) if d != row["t"] else False) or (k == row["k"] and equal and d == row["t"])]
                want = (min(days) if forward else max(days)) if days else None
                assert row["v"] == (float(want) if want is not None else None)


def test_scoreboard_right_then_wrong(spark):
    calls = small_table(spark, [("A", "2026-07-01", 3, "up"), ("B", "2026-07-01", -3, "down")], "ticker string, d string, net bigint, dir string").select(
        "ticker", F.col("d").cast("date").alias("date"), "net", "dir")
    prices = small_table(spark, [("A", "2026-06-30", 100.0), ("A", "2026-07-02", 105.0), ("A", "2026-07-08", 90.0), ("B", "2026-07-01", 50.0)],
                         "ticker string, d string, close double").select("ticker", F.col("d").cast("date").alias("date"), "close")
    got = {r["ticker"]: r for r in scoreboard.score_calls(calls, prices).collect()}
    assert (got["A"]["correct_1d"], got["A"]["correct_7d"], got["B"]["correct_1d"]) == (True, False, None)


def test_allocation_sums_exactly(spark):
    w = small_table(spark, [(1, i, n) for i, n in enumerate([3, 3, 3, 1])], "group_id bigint, idx bigint, weight bigint")
    total = small_table(spark, [(1, 101)], "group_id bigint, total bigint")
    got = [r["allocated"] for r in ratings.allocate(total, w).orderBy("idx").collect()]
    assert sum(got) == 101 and got == [31, 30, 30, 10]


def test_sector_share(spark):
    stats = small_table(spark, [("A", 8.0, 2, 1), ("B", 3.0, 1, 1), ("C", 9.0, 0, 0)], "ticker string, score double, mentions bigint, focused_mentions bigint")
    stocks = small_table(spark, [("A", "chips"), ("B", "")], "ticker string, sector string")
    got = {r["sector"]: r["share"] for r in boards.sector_breakdown(stats, stocks).collect()}
    assert got == {"chips": 72.7, "其他": 27.3}


def test_retention_keeps_old_note_with_fresh_comment(spark):
    now = 40 * 86_400_000
    notes = small_table(spark, [("old", 0), ("talked", 0), ("new", now)], "note_id string, publish_time_ms bigint")
    comments = small_table(spark, [("c", "talked", now)], "comment_id string, note_id string, create_time_ms bigint")
    kept = tables.sweep({"notes": notes, "comments": comments}, now)["notes"]
    assert {r["note_id"] for r in kept.collect()} == {"talked", "new"}


def test_corpus_quotes_against_brute_force(spark):
    rnd = random.Random(2)
    docs = [(i, "".join(rnd.choice("abc ") for _ in range(200))) for i in range(30)]
    qs = [(i, docs[i][1][j:j + n]) for i, (j, n) in enumerate([(0, 1), (5, 2), (9, 7), (30, 15), (1, 64), (100, 100)])] + [(99, "zzz"), (98, "!!")]
    got = {tuple(r) for r in quotes.find_quotes(small_table(spark, qs, "quote_id bigint, quote string"), small_table(spark, docs, "text_id bigint, text string")).collect()}
    strip = lambda s: s.replace(" ", "").replace("!", "")
    assert got == {(q, d) for q, s in qs for d, text in docs if strip(s) and strip(s) in strip(text)}


def test_trailing_budget_boundary(spark):
    day = 86_400_000
    runs = small_table(spark, [(1, 0, 5), (2, day, 7), (3, day + 1, 1), (4, day + 1, 2)], "id bigint, started_at_ms bigint, requests_est bigint")
    got = {r["id"]: r["used_24h"] for r in ledger.trailing_budget(runs, 100, 0).collect()}
    assert got == {1: 5, 2: 12, 3: 10, 4: 10}


def test_asof_and_trailing_sums_with_one_hot_key(spark):
    """Most rows of one key share a few times: the ordered part holds only the different ones."""
    from crowdgauge.operators.asof import asof_join
    from crowdgauge.operators.ledger import trailing_budget

    left = spark.range(5_000).selectExpr("id", "if(id % 10 < 9, 'hot', 'cold') AS k", "cast(id % 7 AS bigint) AS at")
    right = spark.createDataFrame([("hot", 2, 1.5), ("hot", 5, 2.5), ("cold", 0, 9.0)], "k string, day bigint, close double")
    got = asof_join(left, right, ["k"], "at", "day", ["close"]).collect()
    assert len(got) == 5_000
    for r in got:
        want = {"hot": None if r["at"] < 2 else 1.5 if r["at"] < 5 else 2.5, "cold": 9.0}[r["k"]]
        assert r["close"] == want
    runs = spark.range(300).selectExpr("id", "cast(id % 3 AS bigint) * 10 AS started_at_ms", "2L AS requests_est")
    used = {r["started_at_ms"]: r["used_24h"] for r in trailing_budget(runs, 10, 1, span_ms=15, bucket_ms=7).collect()}
    assert used == {0: 200, 10: 400, 20: 400}


def test_logs_are_numbered_per_file(spark, tmp_path):
    from crowdgauge.sources import landing as LD

    for name, n in (("a.log", 50), ("b.log", 3)):
        (tmp_path / name).write_text("\n".join(f"{name} {k}" for k in range(n)) + "\n")
    got = {(r["file"][-5:], r["lineno"]): r["line"] for r in LD.read_logs(spark, str(tmp_path)).collect()}
    assert got == {(name, k): f"{name} {k}" for name, n in (("a.log", 50), ("b.log", 3)) for k in range(n)}
    assert sorted(r["line"] for r in LD.read_logs(spark, str(tmp_path), tail_lines=2).collect()) == ["a.log 48", "a.log 49", "b.log 1", "b.log 2"]
