"""The corpus pipeline: quality, toxicity, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns the columns of
``documents``; the last one returns the packing. ``run`` writes each stage's rows to the shared folder and reads them
again, so a lost executor never goes back more than one stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crowdgauge.llm import exact_dedup, ngram_join, packing, quality, toxicity
from crowdgauge.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees."""
    return quality.passing(docs, quality.fitted(docs, table(spark, sf_dir, "labels")))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    return toxicity.clean(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, that of the largest id."""
    return exact_dedup.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share four of five 5-word n-grams, that of the smallest id."""
    return ngram_join.without_near_copies(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every token of every document that is left."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("toxicity", toxicity_filter), ("exact_dedup", exact_copies),
          ("ngram_jaccard_join", near_copies), ("best_fit_packing", best_fit_packing)]

# The trees, the decoding and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
