"""Logs by keyword: every line belongs to the last keyword before it, however the log is split."""

import random

from pyspark.sql import functions as F

from crowdgauge.operators import ledger, logs
from crowdgauge.session import small_table

LINES = "run_id bigint, lineno bigint, line string"


def sample(rnd, runs=4, n=60):
    kinds = ["2024-01-01 00:00:0{d} x INFO - Current search keyword: k{k} ", "Current search keyword: k{k}", "CAPTCHA appeared, CAPTCHA appeared",
             "Begin get note id comments {k}", "2024 a ERROR (f.py:1) - bad {k}", "KeyError: {k}", "", "plain {k}"]
    return [(r, i * 3, rnd.choice(kinds).format(d=rnd.randint(0, 9), k=rnd.randint(0, 5))) for r in range(runs) for i in range(n)] + [(9, 0, None)]


def test_keywords_are_carried_over_splits(spark):
    rows = sample(random.Random(2))
    want, now = {}, {}
    for r, i, line in sorted(rows, key=lambda x: x[:2]):
        if line and line.startswith("2024-") and "keyword: " in line:
            now[r] = line.split("keyword: ")[1].strip()
        want[r, i] = now.get(r)
    df = small_table(spark, rows, LINES)
    for split in (1, 7, 10_000):
        got = {(x["run_id"], x["lineno"]): x["under"] for x in logs.under_keywords(logs.extracted(df), split).collect()}
        assert got == want


def test_anatomy_counts_every_line_once(spark):
    rows = sample(random.Random(6))
    df = small_table(spark, rows, LINES)
    planned = small_table(spark, [(r, p, k) for r in range(5) for p, k in enumerate(["k1", "k9", "k0"])], "run_id bigint, pos int, keyword string")
    runs = small_table(spark, [(r, s) for r, s in enumerate(["success", "running", "failed", "failed", "failed"])] + [(9, "failed")], "run_id bigint, status string")
    yields = small_table(spark, [(0, "k1", 3, 4), (0, "other", 1, 1)], "run_id bigint, keyword string, notes bigint, comments bigint")
    got = logs.anatomy(df, planned, runs, yields, split=5).collect()
    assert len({(x["run_id"], x["keyword"]) for x in got}) == len(got)
    for r in range(4):
        mine = [x for x in got if x["run_id"] == r]
        assert sum(x["captchas"] for x in mine) == 2 * sum(a == r and "CAPTCHA" in line for a, _, line in rows if line)
        assert sum(x["comment_notes"] for x in mine) == sum(a == r and line.startswith("Begin") for a, _, line in rows if line)
        assert {e for x in mine for e in x["exceptions"]} <= {line for a, _, line in rows if a == r}
        assert all(len(x["errors"]) <= 5 and len(x["exceptions"]) <= 4 for x in mine)
    places = {(x["run_id"], x["keyword"]): x for x in got}
    assert places[0, "k9"]["keyword_index"] == 2 and places[0, "k9"]["state"] == "not_reached"
    assert (places[0, "k1"]["notes"], places[0, "k1"]["comments"]) == (3, 4)
    assert {x["state"] for x in got if x["run_id"] == 4} == {"not_reached"}  # a run without log
    empty = logs.anatomy(small_table(spark, [], LINES), planned, runs, yields).collect()
    assert len(empty) == 15 and all(x["errors"] == [] and x["captchas"] == 0 for x in empty)


def test_admission_does_not_ask_ids_to_be_dense(spark):
    rnd = random.Random(3)
    rows = [(i, i * 600_000, i * 600_000 + 1000, rnd.choice([None, None, "login_required", "x"]), rnd.randint(1, 40)) for i in range(300)]
    schema = "id bigint, started_at_ms bigint, finished_at_ms bigint, error string, requests_est bigint"
    how = {"limit": 500, "estimate": 20, "cooldown_ms": 3_000_000, "gap_ms": 500_000}
    dense, sparse = ({r["id"] // k: tuple(r)[1:] for r in ledger.admission(
        small_table(spark, [(r[0] * k, *r[1:]) for r in rows], schema).withColumn("status", F.lit("success")), **how).collect()} for k in (1, 10**6))
    assert dense == sparse and len(dense) == 300 and len({v[0] for v in dense.values()}) > 1
