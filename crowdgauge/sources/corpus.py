"""Views that present the shared test tables in this library's schemas.

``documents`` stand in for posts and ``conversations`` for comments. Every row is used; ages
spread over the 72-hour context window, so a context-wide operator reads the whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T

NOW_MS = 1704153600000 + 28 * K.DAY_MS
CONTEXT_MS = K.CONTEXT_HOURS * K.HOUR_MS
FRESH_MS = K.FRESH_HOURS * K.HOUR_MS
AGE_MINUTES = K.CONTEXT_HOURS * 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _published(doc_id):
    return F.lit(NOW_MS) - (doc_id * 7919 % AGE_MINUTES) * 60_000


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    i = F.col("doc_id")
    return d.select(
        i.cast("string").alias("note_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("note_desc"),
        F.lit("normal").alias("note_type"),
        _published(i).alias("publish_time_ms"),
        (i * 131 % 1000).alias("liked_count"),
        F.concat(F.lit("/n/"), i.cast("string")).alias("note_url"),
        F.concat(F.lit("#"), F.col("lang"), F.lit("[话题]#")).alias("tag_list"),
        F.col("source").alias("source_keyword"),
        (i % 3 + 1).alias("last_seen_run_id"),
        _published(i).alias("fetched_at_ms"),
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn")
    return c.select(
        F.concat_ws("-", conv, turn.cast("string")).alias("comment_id"),
        conv.alias("note_id"),
        F.when(turn > 0, F.concat(conv, F.lit("-0"))).alias("parent_comment_id"),
        F.col("text").alias("content"),
        (_published(F.col("conv_id")) + (turn + 1) * 60_000).alias("create_time_ms"),
        ((F.col("conv_id") * 31 + turn * 17) % 100).alias("like_count"),
        F.when(
            F.length(T.norm_for_hash("text")) >= K.MIN_COMMENT_DEDUP_LEN, T.norm_for_hash("text")
        ).alias("content_norm_hash"),
    )
