"""Matching: theta joins against the dictionary, mention table, topics."""

from pyspark.sql import functions as F

from crowdgauge.operators import dictionary as D
from crowdgauge.operators import matching as M

from .base import Registry
from .sqlparts import CUT, FRESH_CUT

Q = Registry()
M_COLS = "ticker, source_type, source_id, note_id, matched_alias, match_basis, content_time_ms, run_id"


def unmarked(t):
    return t.ingested_notes, t.ingested_comments


def texts(t):
    n, c = unmarked(t)
    return M.normalised(M.mention_texts(n, c, t.now - t.context), t.dictionary)


@Q.add("j15_alias_hits", "hits", "SELECT source_type, source_id, ticker, alias, kind FROM hits WHERE kind IN ('safe', 'ambiguous')")
def _(t):
    terms = D.match_terms_of(t.dictionary, t.tracked).filter("kind IN ('safe', 'ambiguous')")
    return M.match_terms(texts(t), terms, ["source_type", "source_id"]).select("source_type", "source_id", "ticker", "alias", "kind")


@Q.add("j16_symbol_hits", "hits", "SELECT source_type, source_id, ticker, collision FROM hits WHERE kind = 'symbol'")
def _(t):
    terms = D.match_terms_of(t.dictionary, t.tracked).filter("kind = 'symbol'")
    return M.match_terms(texts(t), terms, ["source_type", "source_id"], raw="raw_text").select("source_type", "source_id", "ticker", "collision")


@Q.add("c01_mentions", "mentions", f"SELECT {M_COLS} FROM mentions")
def _(t):
    return t.mentions


EXISTING = f"""SELECT ticker, source_type, source_id, note_id, 'old' AS matched_alias,
  CASE WHEN length(source_id) % 2 = 0 THEN 'targeted_search' ELSE 'ticker_symbol' END AS match_basis,
  content_time_ms - 5 AS content_time_ms, CAST(1 AS BIGINT) AS run_id FROM mentions WHERE ticker IN ('THN', 'ERN')
  UNION ALL SELECT 'GONE', 'note', note_id, note_id, 'old', 'safe_alias', publish_time_ms, 1 FROM notes0
  UNION ALL SELECT 'PAST', 'note', note_id, note_id, 'old', 'safe_alias', {CUT} - 1, 1 FROM notes0"""


def existing(t, m):
    n = unmarked(t)[0]
    old = m.filter("ticker IN ('THN', 'ERN')").select(
        "ticker", "source_type", "source_id", "note_id", F.lit("old").alias("matched_alias"),
        F.when(F.length("source_id") % 2 == 0, "targeted_search").otherwise("ticker_symbol").alias("match_basis"),
        (F.col("content_time_ms") - 5).alias("content_time_ms"), F.lit(1).cast("bigint").alias("run_id"))

    def fixed(ticker, time):
        return n.select(F.lit(ticker).alias("ticker"), F.lit("note").alias("source_type"), F.col("note_id").alias("source_id"), "note_id",
                        F.lit("old").alias("matched_alias"), F.lit("safe_alias").alias("match_basis"), time.alias("content_time_ms"), F.lit(1).cast("bigint").alias("run_id"))

    return old.unionByName(fixed("GONE", F.col("publish_time_ms"))).unionByName(fixed("PAST", F.lit(t.now - t.context - 1)))


ST = "CASE {}.match_basis WHEN 'safe_alias' THEN 4 WHEN 'ticker_symbol' THEN 3 WHEN 'alias+context' THEN 2 ELSE 1 END"


@Q.add("c02_mention_refresh", "mentions notes0", f"""
  WITH old AS ({EXISTING})
  SELECT coalesce(o.ticker, n.ticker) AS ticker, coalesce(o.source_type, n.source_type) AS source_type, coalesce(o.source_id, n.source_id) AS source_id,
    coalesce(o.note_id, n.note_id) AS note_id,
    CASE WHEN o.ticker IS NULL OR (n.ticker IS NOT NULL AND {ST.format('n')} > {ST.format('o')}) THEN n.matched_alias ELSE o.matched_alias END AS matched_alias,
    CASE WHEN o.ticker IS NULL OR (n.ticker IS NOT NULL AND {ST.format('n')} > {ST.format('o')}) THEN n.match_basis ELSE o.match_basis END AS match_basis,
    coalesce(o.content_time_ms, n.content_time_ms) AS content_time_ms, coalesce(o.run_id, n.run_id) AS run_id
  FROM old o FULL JOIN mentions n ON n.ticker = o.ticker AND n.source_type = o.source_type AND n.source_id = o.source_id
  WHERE n.ticker IS NOT NULL OR o.content_time_ms < {CUT}""")
def _(t):
    m = t.mentions
    return M.refresh_mentions(existing(t, m), m, t.now - t.context)


@Q.add("t01_stale_mentions", "mentions notes0", f"""
  WITH old AS ({EXISTING})
  SELECT ticker, source_type, source_id FROM old o WHERE content_time_ms >= {CUT} AND NOT EXISTS (
    SELECT 1 FROM mentions n WHERE n.ticker = o.ticker AND n.source_type = o.source_type AND n.source_id = o.source_id)""")
def _(t):
    m = t.mentions
    return M.stale_mentions(existing(t, m), m, t.now - t.context).select("ticker", "source_type", "source_id")


TOPIC = r"""SELECT DISTINCT n.note_id, n.liked_count, n.publish_time_ms, k.tag FROM notes n JOIN topics k ON
  CASE WHEN regexp_full_match(k.term, '[0-9a-z&.\- ]+') THEN contains(x, k.term) AND regexp_matches(x, '(^|[^0-9a-z])' || k.term || '([^0-9a-z]|$)') ELSE contains(x, k.term) END
  WHERE n.dup_group_id IS NULL""".replace("(x,", "(lower(concat_ws(' ', nullif(n.title, ''), nullif(n.note_desc, ''), nullif(n.tag_list, ''))),")


@Q.add("f14_topic_tags", "notes topics", f"SELECT note_id, tag FROM ({TOPIC})")
def _(t):
    n = t.notes.filter("dup_group_id IS NULL").select("note_id", F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in ("title", "note_desc", "tag_list")]).alias("text"))
    return M.topic_hits(n, t.dictionary, ["note_id"]).select("note_id", "tag")


@Q.add("g10_topic_breakdown", "notes topics", f"SELECT tag, count(*) AS mentions, CAST(sum(liked_count) AS BIGINT) AS likes FROM ({TOPIC}) WHERE publish_time_ms >= {CUT} GROUP BY 1")
def _(t):
    return M.topic_breakdown(t.notes, t.dictionary, t.context, t.now)


@Q.add("j03_comment_provenance", "comments0 notes0", f"SELECT c.comment_id, n.source_keyword FROM comments0 c JOIN notes0 n ON n.note_id = c.note_id WHERE c.create_time_ms >= {FRESH_CUT}")
def _(t):
    n, c = unmarked(t)
    return c.filter(F.col("create_time_ms") >= t.now - t.fresh).join(n.select("note_id", "source_keyword"), "note_id").select("comment_id", "source_keyword")


@Q.add("u03_match_table_function", "", r"""
  SELECT conv_id, turn, ticker, alias FROM conversations, (VALUES ('THN', 'thon'), ('BRK', 'of the'), ('UNE', 'lé'), ('ERN', 'erin')) v(ticker, alias)
  WHERE CASE WHEN alias = 'lé' THEN contains(lower(text), alias) ELSE regexp_matches(lower(text), '(^|[^0-9a-z])' || alias || '([^0-9a-z]|$)') END""")
def _(t):
    from crowdgauge.streaming.udtf import register_match_entities
    fn = register_match_entities(t.spark, [("THN", "thon"), ("BRK", "of the"), ("UNE", "lé"), ("ERN", "erin")])
    c = t.raw("conversations")
    return c.lateralJoin(fn(F.col("text").outer())).select("conv_id", "turn", "ticker", "alias")


@Q.add("u03_match_mentions", "mentions", "SELECT ticker, source_type, source_id, note_id, matched_alias, match_basis, content_time_ms FROM mentions")
def _(t):
    from crowdgauge.operators.dictionary import tracked_queries
    from crowdgauge.streaming.udtf import register_match_mentions
    match = register_match_mentions(t.spark, t.dictionary, t.tracked)
    texts = M.mention_texts(t.ingested_notes, t.ingested_comments, t.now - t.context, tracked_queries(t.dictionary, t.tracked))
    return match(texts.asTable())
