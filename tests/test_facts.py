"""Facts of mentions: equal to the text functions, and nothing that reads them moves a text."""

import re

from pyspark.sql import functions as F

from crowdgauge import constants as K
from crowdgauge.functions import text as T
from crowdgauge.operators import evidence, heat
from crowdgauge.operators.facts import with_facts

LONG = "market opens. " * 40
NOTES = [("1", "Acme rises", "Acme rises today #Acme[话题]# and all of the market follows suit", 10, 100), ("2", None, LONG + "acme", 11, 5),
         ("3", "t", "", 12, None), ("4", "#Acme[话题]#", "words about other things entirely", 13, 0), ("5", "Ａｃｍｅ wide", LONG + LONG, 14, 1)]


def tables(spark):
    notes = spark.createDataFrame(NOTES, "note_id string, title string, note_desc string, publish_time_ms long, liked_count long").withColumns(
        {"dup_group_id": F.lit(None).cast("string"), "note_url": F.concat(F.lit("/"), "note_id")})
    comments = spark.createDataFrame([("c1", "1", "Acme is what everyone here talks about", None, 20, 3), ("c2", "1", "me too, and a lot", "c1", 21, 9), ("c3", "2", None, None, 22, 1)],
                                     "comment_id string, note_id string, content string, parent_comment_id string, create_time_ms long, like_count long")
    comments = comments.withColumn("dup_group_id", F.lit(None).cast("string"))
    rows = [("ACM", "note", str(k), "Acme", 10 + k) for k in range(1, 6)] + [("ACM", "comment", "c1", "acme", 20), ("ACM", "comment", "c3", "acme", 22), ("BBB", "note", "1", "today", 11)]
    mentions = spark.createDataFrame(rows, "ticker string, source_type string, source_id string, matched_alias string, content_time_ms long")
    return notes, comments, mentions


def test_facts_equal_the_text_functions(spark):
    notes, comments, mentions = tables(spark)
    got = {(r.ticker, r.source_id): r.facts for r in with_facts(mentions, notes, comments).collect()}
    assert len(got) == 8
    full = T.clean_tags(T.note_text("title", "note_desc"))
    raw = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("note_desc", F.lit("")))
    want = mentions.filter("source_type = 'note'").join(notes, F.col("source_id") == F.col("note_id")).select(
        "ticker", "source_id", T.has_term(F.lower(T.strip_hashtags(T.norm_text(raw))), "matched_alias").alias("in_prose"),
        T.is_aside(full, T.term_count(full, "matched_alias")).alias("aside"), (T.substance(full) >= K.QUOTE_MIN_SUBSTANCE).alias("readable"),
        F.substring(full, 1, K.TOP_QUOTE_LEN).alias("quote"), T.excerpt(full, T.term_position(full, "matched_alias")).alias("excerpt"))
    for r in want.collect():
        f = got[r.ticker, r.source_id]
        assert (f.in_prose, f.aside, f.readable, f.quote, f.excerpt) == (r.in_prose, r.aside, r.readable, r.quote, r.excerpt), r
    assert not got["ACM", "4"].in_prose and got["ACM", "2"].aside
    assert got["ACM", "c3"].quote == "" and got["ACM", "c1"].head is None


def test_mentions_without_facts_give_the_same_stats(spark):
    notes, comments, mentions = tables(spark)
    outside = spark.createDataFrame([], "ticker string")
    told = with_facts(mentions, notes, comments)
    plain, fast = (sorted(map(tuple, heat.compute_stats(m, notes, comments, 10**6, 100, outside).collect()), key=str) for m in (mentions, told))
    assert plain == fast and plain


def exchanged(df):
    """The columns that exchanges of the final plan put out."""
    return re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted"))


def test_no_text_in_an_exchange(spark, tmp_path):
    notes, comments, mentions = tables(spark)
    for name, df in (("n", notes), ("c", comments), ("m", with_facts(mentions, notes, comments))):
        df.write.parquet(str(tmp_path / name))
    n, c, m = (spark.read.parquet(str(tmp_path / x)) for x in "ncm")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stats = heat.compute_stats(m, n, c, 10**6, 100, spark.createDataFrame([], "ticker string"))
        items = evidence.gather(m, n, c, 10**6, 100)
        for df in (stats, items):
            moved = exchanged(df)
            assert moved and not [x for x in moved if re.search(r"\b(title|note_desc|content|body|_full|_clean|_prose)#", x)]
        plan = stats._sc._jvm.PythonSQLUtils.explainString(stats._jdf.queryExecution(), "formatted")
        assert not re.search(r"ReadSchema: .*(note_desc|content:)", plan)
        scans = items._sc._jvm.PythonSQLUtils.explainString(items._jdf.queryExecution(), "simple").count("FileScan parquet")
        assert scans < 15, scans
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
