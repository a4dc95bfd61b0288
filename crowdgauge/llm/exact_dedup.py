"""Exact dedup: local, salted and global combining, with whole texts compared at every stage.

DataFrame functions only. A group key is (digest, text), so two texts meet only if they are equal;
the digest just deals them out.

1. Local: Spark's partial aggregation folds the copies inside each input partition.
2. Salted: folded rows meet by (digest, salt, text). A text that a third of all rows carry is spread
   over ``salts`` tasks, and each passes on one row.
3. Global: salt winners meet by digest. The table of winners is written without texts.

Every document then looks up its winner by digest. The join is an ordinary equi-join of two narrow
sides, so adaptive execution can split a hot digest. Should two different texts share a digest,
the table says so and these rows, and only these, are joined by digest and whole text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, id_and_text, split_by_ids, written

SALTS = 16


def sha256_of(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS,
                digest: Callable[[Column], Column] = sha256_of) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each input row.

    Texts are equal when identical after lower-casing A-Z. Null text is empty text, and all empty
    texts form one group. Of equal texts the largest id stays; rows that repeat an id count in
    ``group_size`` and get the same answer. A null id never wins over another id; a group of null ids
    alone keeps them. No rows in, no rows out. Columns beyond the two named are not read."""
    rows = id_and_text(docs, id_col, text_col).select("doc_id", ascii_lower(F.col("text")).alias("norm"))
    keyed = rows.select("doc_id", "norm", digest(F.col("norm")).alias("digest"),
                        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"))
    salted = keyed.groupBy("digest", "salt", "norm").agg(F.max("doc_id").alias("keep_id"),
                                                         F.count(F.lit(1)).alias("group_size"))
    merged = salted.repartition("digest").groupBy("digest", "norm").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    per_digest = merged.groupBy("digest").agg(F.max("keep_id").alias("keep_id"),
                                              F.sum("group_size").alias("group_size"),
                                              F.count(F.lit(1)).alias("texts"))
    winners = written(per_digest, "dedup-winners")
    found = keyed.select("doc_id", "digest", sha256_of(F.col("norm")).alias("text_sha256")).join(
        winners.filter("texts = 1"), "digest")
    if not winners.filter("texts > 1").isEmpty():
        shared = winners.filter("texts > 1").select("digest")
        exact = keyed.join(shared, "digest", "left_semi").select("doc_id", "digest", "norm")
        found = found.drop("texts").unionByName(
            exact.join(merged.join(shared, "digest", "left_semi"), ["digest", "norm"])
            .select("doc_id", "digest", sha256_of(F.col("norm")).alias("text_sha256"), "keep_id", "group_size"))
    return found.select("doc_id", "keep_id", "group_size",
                        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    Of rows that repeat the winning id with the same text one stays; rows that share an id but not the text are decided each by its
    own text. Rows with a null id are compared among themselves. Only rows that
    may go, by a filter of fixed size over the ids in question, are joined by id; the others pass as they are
    read."""
    found = written(exact_dedup(docs, id_col, text_col).select("doc_id", "text_sha256", "kept"), "dedup-decisions").filter("doc_id is not null")
    goes = found.filter("not kept").select("doc_id", "text_sha256").distinct()
    asked = goes.select("doc_id").unionByName(found.groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    passed, open_rows = split_by_ids(docs, asked, id_col)
    norm, sha = (f"{n}_{uuid.uuid4().hex}" for n in ("norm", "sha"))
    lowered = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    nameless = passed.filter(F.col(id_col).isNull()).withColumn(norm, lowered)
    goes = goes.select(F.col("doc_id").alias(id_col), F.col("text_sha256").alias(sha))
    stays = open_rows.withColumn(sha, sha256_of(lowered)).join(goes, [id_col, sha], "left_anti").dropDuplicates([id_col, sha]).select(*docs.columns)
    return passed.filter(F.col(id_col).isNotNull()).unionByName(stays).unionByName(nameless.dropDuplicates([norm]).drop(norm))
