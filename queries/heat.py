"""Heat score, its joins and fan-outs, keyword yield."""

from pyspark.sql import functions as F

from crowdgauge.operators import dedup as DD
from crowdgauge.operators import heat as H
from crowdgauge.operators import keywords as KW
from crowdgauge.operators import tables as TB

from .base import Registry
from .sqlparts import CUT

Q = Registry()
STAT_COLS = ["ticker", "note_count", "comment_count", "note_count_raw", "comment_count_raw", "focused_mentions", "mentions", "score", "latest_item_ms", "top_quote"]
S = ", ".join(STAT_COLS)


@Q.add("j01_note_mentions", "mentions notes", "SELECT m.ticker, m.source_id, n.liked_count AS likes FROM mentions m JOIN notes n ON n.note_id = m.source_id WHERE m.source_type = 'note'")
def _(t):
    return H.note_mentions(t.mentions, t.notes).select("ticker", "source_id", "likes")


@Q.add("j02_comment_mentions", "mentions comments", "SELECT m.ticker, m.source_id, c.like_count AS likes FROM mentions m JOIN comments c ON c.comment_id = m.source_id WHERE m.source_type = 'comment'")
def _(t):
    return H.comment_mentions(t.mentions, t.comments).select("ticker", "source_id", "likes")


@Q.add("j04_thread_pull", "mentions notes comments", f"""SELECT m.ticker, c.comment_id FROM mentions m JOIN notes n ON n.note_id = m.source_id JOIN comments c ON c.note_id = n.note_id
  WHERE m.source_type = 'note' AND m.content_time_ms >= {CUT} AND c.create_time_ms >= {CUT} AND c.dup_group_id IS NULL""")
def _(t):
    n = H.note_mentions(t.mentions, t.notes).filter(F.col("content_time_ms") >= t.now - t.context).select("ticker", F.col("source_id").alias("note_id"))
    c = t.comments.filter((F.col("create_time_ms") >= t.now - t.context) & F.col("dup_group_id").isNull())
    return n.join(c.select("note_id", "comment_id"), "note_id").select("ticker", "comment_id")


@Q.add("j05_known_note_comments", "comments0 notes0", "SELECT comment_id FROM comments0 c WHERE EXISTS (SELECT 1 FROM notes0 n WHERE n.note_id = c.note_id AND n.liked_count >= 300)")
def _(t):
    n = t.ingested_notes.filter("liked_count >= 300")
    return t.ingested_comments.join(n.select("note_id"), "note_id", "left_semi").select("comment_id")


@Q.add("j06_unmatched_notes", "mentions notes", "SELECT note_id FROM notes n WHERE dup_group_id IS NULL AND NOT EXISTS (SELECT 1 FROM mentions m WHERE m.source_type = 'note' AND m.source_id = n.note_id)")
def _(t):
    from crowdgauge.operators.suggestions import unmatched_notes
    return unmatched_notes(t.notes, t.mentions, t.now - t.context).select("note_id")


@Q.add("j07_notes_without_comments", "notes0 comments0", "SELECT note_id FROM notes0 n WHERE NOT EXISTS (SELECT 1 FROM comments0 c WHERE c.note_id = n.note_id)")
def _(t):
    return TB.without_comments(t.ingested_notes, t.ingested_comments).select("note_id")


YIELD = """SELECT n.source_keyword AS keyword, count(DISTINCT n.note_id) AS notes, count(DISTINCT m.source_id) AS with_stock,
  round(count(DISTINCT m.source_id) / count(DISTINCT n.note_id), 2) AS hit_rate, count(DISTINCT m.ticker) AS n_tickers,
  coalesce(array_to_string(list_sort(list(DISTINCT m.ticker) FILTER (m.ticker IS NOT NULL)), ','), '') AS tickers
  FROM notes0 n LEFT JOIN mentions m ON m.source_type = 'note' AND m.source_id = n.note_id WHERE {} GROUP BY 1"""


def yields(df):
    return df.withColumns({"tickers": F.array_join("tickers", ","), "n_tickers": F.col("n_tickers").cast("bigint")})


@Q.add("g11_keyword_yield", "mentions notes0", YIELD.format("true"))
def _(t):
    return yields(KW.yield_stats(t.ingested_notes, t.mentions))


@Q.add("j08_keyword_yield_of_run", "mentions notes0", YIELD.format("n.last_seen_run_id = 2"))
def _(t):
    return yields(KW.yield_stats(t.ingested_notes, t.mentions, run_id=2))


@Q.add("g01_source_tickers", "mentions", "SELECT source_type, source_id, array_to_string(list_sort(list(DISTINCT ticker)), ',') AS tickers FROM mentions GROUP BY 1, 2")
def _(t):
    return H.source_tickers(t.mentions, t.now - t.context).withColumn("tickers", F.array_join("tickers", ","))


@Q.add("g02_class_fanout", "mentions classes", """SELECT m.ticker, source_type, source_id, count(*) OVER (PARTITION BY source_type, source_id, coalesce(is_non_stock, false)) AS fanout
  FROM mentions m LEFT JOIN classes c ON c.ticker = m.ticker""")
def _(t):
    return H.class_fanout(t.mentions, t.now - t.context, t.outside).select("ticker", "source_type", "source_id", "fanout")


@Q.add("g03_total_fanout", "fan", "SELECT source_type, source_id, fanout FROM fan")
def _(t):
    return H.source_fanout(t.mentions, t.now - t.context)


@Q.add("g04_heat_score", "stats", f"SELECT {S} FROM stats")
def _(t):
    return t.stats.select(*STAT_COLS)


@Q.add("g04_heat_two_windows", "stats fresh_stats", f"SELECT 'context' AS \"window\", {S} FROM stats UNION ALL SELECT 'fresh', {S} FROM fresh_stats")
def _(t):
    return t.windows.select("window", *STAT_COLS)


@Q.add("g05_top_quote", "stats", "SELECT ticker, top_quote FROM stats")
def _(t):
    return t.stats.select("ticker", "top_quote")


@Q.add("g08_cluster_sizes", "notes comments", "SELECT coalesce(dup_group_id, note_id) AS id, count(*) AS cluster_size FROM notes GROUP BY 1 UNION ALL SELECT coalesce(dup_group_id, comment_id), count(*) FROM comments GROUP BY 1")
def _(t):
    n = DD.cluster_sizes(t.notes, "note_id", "publish_time_ms", t.context, t.now)
    c = DD.cluster_sizes(t.comments, "comment_id", "create_time_ms", t.context, t.now)
    return n.withColumnRenamed("note_id", "id").unionByName(c.withColumnRenamed("comment_id", "id"))
