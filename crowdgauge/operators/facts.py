"""What heat and evidence need to know of a mention, told once when the mention is found.

Each fact is a flag, a number or a snippet of bounded length, so nothing that reads mentions later needs a text again: boards of
several windows, evidence, threads and cards are joins of narrow rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T

# fixed values: wording of thread heads
UNDER_POST = "主帖下的评论"
UNDER_TITLED = ("主帖「", "」下的评论")
TAG_MARK = "[话题]#"


def with_bodies(rows: DataFrame) -> DataFrame:
    """Adds the forms of a text that facts are read from; input columns are ``source_type``, ``title`` and ``body``, which is
    the content of a comment."""
    note = F.col("source_type") == "note"
    raw = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")))
    # A text on one line is its own clean form if it holds no tag mark.
    line = F.when(note, T.note_text("title", "body")).otherwise(T.squeeze("body"))
    full = T.once(line, lambda x: F.when(note & F.contains(x, F.lit(TAG_MARK)), T.clean_tags(x)).otherwise(x))
    prose = F.when(note, F.lower(T.strip_hashtags(T.norm_text(raw))))
    rows = rows.withColumns({"_full": full, "_prose": prose, "_title": F.when(note, F.substring(T.clean_tags("title"), 1, K.TITLE_SNIPPET))})
    rows = rows.withColumn("_clean", F.lower(T.norm_text("_full"))).withColumn(
        "_whole", T.substance_up_to("_full", max(K.MIN_NOTE_SUBSTANCE, K.QUOTE_MIN_SUBSTANCE)))
    head = F.when(F.col("_whole") >= K.MIN_NOTE_SUBSTANCE, F.concat(F.lit(UNDER_TITLED[0]), F.col("_title"), F.lit(UNDER_TITLED[1]))).otherwise(F.lit(UNDER_POST))
    return rows.withColumns({"_readable": F.col("_whole") >= K.QUOTE_MIN_SUBSTANCE, "_quote": F.substring("_full", 1, K.TOP_QUOTE_LEN), "_head": F.when(note, head)})


def facts(alias: Column, pos: Column) -> Column:
    """What a text prepared by ``with_bodies`` tells of one mention, first found at ``pos``."""
    note = F.col("source_type") == "note"
    return F.struct(
        F.when(note, T.has_term("_prose", alias)).otherwise(True).alias("in_prose"),
        F.when(note, (F.length("_full") >= K.ASIDE_MIN_LEN) & T.at_most_once("_clean", alias)).otherwise(False).alias("aside"),
        F.when(note, T.excerpt("_full", pos)).alias("excerpt"))


def with_facts(mentions: DataFrame, notes: DataFrame, comments: DataFrame) -> DataFrame:
    """Mentions with ``facts``: as they are if the matcher told them, else read from the texts, which then meet the mentions of a source
    as one array, so that each text moves and is prepared once."""
    if "facts" in mentions.columns:
        return mentions
    key = ["source_type", "source_id"]
    rest = [c for c in mentions.columns if c not in key]
    named = mentions.groupBy(*key).agg(F.collect_list(F.struct(*rest)).alias("named"))
    n = notes.select(F.lit("note").alias("source_type"), F.col("note_id").alias("source_id"), "title", F.col("note_desc").alias("body"))
    c = comments.select(F.lit("comment").alias("source_type"), F.col("comment_id").alias("source_id"), F.lit(None).cast("string").alias("title"), F.col("content").alias("body"))
    texts = with_bodies(n.unionByName(c).join(named, key))
    # Positions and facts are made inside the array: after the explode Spark would repeat the preparation for every mention.
    found = F.transform("named", lambda m: F.struct(m.alias("m"), T.position_in("_clean", m["matched_alias"]).alias("pos")))
    texts = texts.withColumn("named", found)
    told = F.transform("named", lambda x: F.struct(x["m"].alias("m"), facts(x["m"]["matched_alias"], x["pos"]).alias("own")))
    # What all mentions of a text share is made beside the array, once a text, and put to the rest behind the explode.
    rows = texts.select(*key, "_readable", "_quote", "_head", F.explode(told).alias("x"))
    whole = F.struct("x.own.in_prose", "x.own.aside", F.col("_readable").alias("readable"), F.col("_quote").alias("quote"),
                     "x.own.excerpt", F.col("_head").alias("head"))
    return rows.select(*[F.col(k) if k in key else F.col(f"x.m.{k}") for k in mentions.columns], whole.alias("facts"))
