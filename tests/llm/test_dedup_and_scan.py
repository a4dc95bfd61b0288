"""Exact dedup and license scans: edge rows, and brute force on whole small tables."""

import hashlib
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from crowdgauge.llm import exact_dedup, license_scan
from crowdgauge.llm.queries import QUERIES

LONG = "word " * 40_000
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROWS = [(1, "Same Text"), (2, "same text"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, LONG), (8, LONG.upper()), (8, LONG.upper()), (None, "same text"),
        (None, "alone")]


def frame(spark, rows):
    """Documents with extra columns whose names operators use themselves."""
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("keep_id", "kept", "norm", "digest", "salt", "row", "lines", "tokens", "label", "n", "grp"):
        d = d.withColumn(c, F.lit("x"))
    return d


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(UPPER), []).append(i)
    out = []
    for i, t in rows:
        norm = (t or "").translate(UPPER)
        ids = [x for x in groups[norm] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest", [exact_dedup.sha256_of, lambda c: F.substring(F.sha2(c, 256), 1, 0), lambda c: F.length(c).cast("string")])
def test_equal_texts_even_if_digests_collide(spark, digest):
    got = exact_dedup.exact_dedup(frame(spark, ROWS), digest=digest, salts=3).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(ROWS)


def test_hot_text_and_empty_table(spark):
    rows = [(k, "copy" if k % 3 else f"own {k}") for k in range(600)]
    got = exact_dedup.exact_dedup(frame(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows)
    assert exact_dedup.exact_dedup(frame(spark, [])).collect() == []


def test_without_copies_keeps_columns_and_one_row(spark):
    docs = frame(spark, ROWS)
    got = exact_dedup.without_copies(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:9]) for r in got.collect()) == [
        (0, "alone"), (0, "same text"), (2, "same text"), (4, ""), (5, "É"), (6, "é"), (8, "WORD WORD")]


def test_without_copies_where_ids_clash(spark):
    rows = [(1, "shared"), (1, "only here"), (2, "Shared"), (3, "one"), (3, "two"), (3, "TWO"), (4, "alone")]
    got = sorted((r["doc_id"], r["text"].lower()) for r in exact_dedup.without_copies(frame(spark, rows)).collect())
    assert got == [(1, "only here"), (2, "shared"), (3, "one"), (3, "two"), (4, "alone")]


def scanned(spark, rows, **more):
    return {r["doc_id"]: r for r in license_scan.license_scan(frame(spark, rows), **more).collect()}


def test_phrases_and_templates(spark):
    got = scanned(spark, [
        (1, "Some GNU General\nPublic License here"), (2, "cc, BY cc by"), (3, None), (4, ""), (5, "the mit licenses"),
        (6, "x\nReleased under the MIT-License!\ny"), (7, "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                                                        "associated documentation files to deal in it without limits"), (8, LONG + "apache license")])
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (1, 1, 1, "gpl")
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"]) == (2, 0, 2)
    for k in (3, 4):
        assert (got[k]["n_words"], got[k]["n_base"], got[k]["first_word"], got[k]["labels"], got[k]["score"]) == (0, 0, None, "", 0.0)
    assert (got[5]["n_base"], got[5]["base_labels"]) == (0, "")
    assert got[6]["labels"] == "mit,mit-notice" and got[6]["score"] == 1.0
    assert got[7]["base_labels"] == "" and got[7]["labels"] == "mit-grant" and 0.8 <= got[7]["score"] < 1
    assert (got[8]["n_words"], got[8]["first_word"]) == (40_002, 40_000)


def test_similarity_join_finds_what_brute_force_finds(spark):
    import random

    rng = random.Random(3)
    words = [f"w{k}" for k in range(12)]
    templates = {f"t{k}": " ".join(rng.sample(words, rng.randrange(2, 9))) for k in range(6)}
    rows = [(k, "\n".join(" ".join(rng.choices(words, k=rng.randrange(0, 12))) for _ in range(3))) for k in range(120)]
    got = scanned(spark, rows, templates=templates, percent=70)
    for k, text in rows:
        lines = [set(x.split()) for x in text.split("\n")]
        want = {name: max(len(set(t.split()) & x) / len(set(t.split())) for x in lines) for name, t in templates.items()}
        near = {n: s for n, s in want.items() if s * 100 >= 70}
        assert got[k]["labels"] == ",".join(sorted(near))
        assert got[k]["score"] == pytest.approx(max(near.values(), default=0.0))
    assert scanned(spark, []) == {}


def test_templates_that_run_over_line_ends(spark, tmp_path):
    grants = {k: v for k, v in license_scan.TEMPLATES.items() if k.endswith("-grant")}
    wrapped = [textwrap.fill(v, 72) for v in grants.values()]
    assert all("\n" in x for x in wrapped)
    texts = [*wrapped, *(textwrap.indent(x, " * ") for x in wrapped), *(x.replace("\n", "\r\n\r\n") for x in wrapped)]
    rows = [(k, f"Copyright someone\n\n{x}\n\nint main") for k, x in enumerate(texts)]
    rows += [(100, "Licensed under the\nApache License, Version 2.0"), (101, "Released under\n\nthe MIT License"), (102, "All\n\nrights\n\n\nreserved"),
             (103, "all\n\nof the rights that are reserved"), (104, ""), (105, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op8_license_scans"](spark, str(tmp_path)).collect()}
    for k in range(len(texts)):
        label = [*grants][k % len(grants)]
        assert label in got[k]["labels"].split(",") and got[k]["score"] == 1.0
        assert got[k]["n_words"] == len(re.findall(r"[a-z0-9]+", rows[k][1].lower()))
    assert [got[k]["labels"] for k in range(100, 106)] == ["apache,apache-2.0-notice", "mit,mit-notice", "all-rights-reserved", "", "", ""]
    assert {r["labels"] for r in license_scan.license_scan(docs, templates={}, across_lines=True).collect()} <= {"", "apache", "mit", "gpl"}
