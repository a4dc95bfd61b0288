"""Evidence: items, threads, hashes, rendering, quotes, overlap."""

from pyspark.sql import functions as F

from crowdgauge.operators import evidence as E
from crowdgauge.operators import quotes as QT
from crowdgauge.operators import suggestions as S
from crowdgauge.plans import board as PB

from .base import Registry
from .sqlparts import norm_hash

Q = Registry()
NOW = 1706572800000
MARKS = """CASE WHEN cluster_size > 1 THEN ' [×' || cluster_size || '相似]' ELSE '' END || CASE WHEN fanout >= 4 THEN ' [盘点·提及' || fanout || '股]' ELSE '' END
  || CASE WHEN aside THEN ' [顺带提及]' ELSE '' END"""
STAMP = f"'[' || type || '] [' || greatest(0, ({NOW} - ts) // 3600000) || '小时前] [赞:' || likes || ']'"


@Q.add("c06_evidence_items", "items", "SELECT ticker, item_no, type, id, text, prompt_text, likes, ts, coalesce(url, '') AS url, CAST(substance AS BIGINT) AS substance, aside, cluster_size, fanout, unit, unit_likes, depth FROM items")
def _(t):
    return t.items.withColumns({"url": F.coalesce("url", F.lit("")), "substance": F.col("substance").cast("bigint")})


@Q.add("c07_thread_lines", "thread_items", "SELECT ticker, id, text, prompt_text, depth, unit, unit_likes FROM thread_items")
def _(t):
    picked = E.picked_comments(t.told_mentions, t.notes, t.comments, t.now - t.context)
    return E.thread_items(picked, t.comments).select("ticker", "id", "text", "prompt_text", "depth", "unit", "unit_likes")


@Q.add("j18_reply_parents", "thread_rows", "SELECT ticker, id, parent FROM thread_rows")
def _(t):
    picked = E.picked_comments(t.told_mentions, t.notes, t.comments, t.now - t.context)
    return E.with_parents(picked, t.comments).select("ticker", "id", "parent")


@Q.add("w07_top_comments_per_note", "picked", "SELECT ticker, id, head FROM picked WHERE head IS NOT NULL")
def _(t):
    return E.picked_comments(t.told_mentions, t.notes, t.comments, t.now - t.context).filter("head IS NOT NULL").select("ticker", "id", "head")


@Q.add("w08_thread_likes", "thread_items", "SELECT DISTINCT ticker, unit, unit_likes FROM thread_items")
def _(t):
    picked = E.picked_comments(t.told_mentions, t.notes, t.comments, t.now - t.context)
    return E.thread_items(picked, t.comments).select("ticker", "unit", "unit_likes").distinct()


@Q.add("w09_item_numbers", "items", "SELECT ticker, item_no, id FROM items")
def _(t):
    return t.items.select("ticker", "item_no", "id")


@Q.add("s06_evidence_cap", "items", "SELECT ticker, count(*) AS n, max(item_no) AS last FROM items GROUP BY 1")
def _(t):
    return t.items.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.max("item_no").alias("last"))


@Q.add("g20_fingerprints", "prints", "SELECT * FROM prints")
def _(t):
    return E.fingerprints(t.items)


@Q.add("f16_rendered_evidence", "items", f"""SELECT ticker, string_agg('[' || item_no || '] ' || {STAMP} || {MARKS} || ' ' || prompt_text, chr(10) ORDER BY item_no) AS evidence,
  bool_or(cluster_size > 1) AS legend_similar, bool_or(fanout >= 4) AS legend_roundup, bool_or(aside) AS legend_aside,
  bool_or(contains(prompt_text, '…')) AS legend_excerpt, bool_or(starts_with(prompt_text, '↳')) AS legend_reply FROM items GROUP BY 1""")
def _(t):
    return E.render(t.items, t.now)


GROUPS = "(SELECT ticker, ascii(ticker) % 3 AS group_id, row_number() OVER (PARTITION BY ascii(ticker) % 3 ORDER BY ticker) AS group_pos FROM (SELECT DISTINCT ticker FROM items))"


def groups(t):
    from pyspark.sql import Window
    k = t.items.select("ticker").distinct().withColumn("group_id", F.ascii("ticker") % 3)
    return k.withColumn("group_pos", F.row_number().over(Window.partitionBy("group_id").orderBy("ticker")))


@Q.add("f17_shared_references", "items", f"""
  WITH g AS {GROUPS}, r AS (SELECT i.*, g.group_id, g.group_pos FROM items i JOIN g ON g.ticker = i.ticker),
  f AS (SELECT group_id, type, id, prompt_text, row_number() OVER (PARTITION BY group_id ORDER BY min((group_pos, item_no))) AS e FROM r GROUP BY 1, 2, 3, 4)
  SELECT r.group_id, r.ticker, string_agg('[' || item_no || ']=E' || e || {MARKS}, ' ' ORDER BY item_no) AS refs
  FROM r JOIN f ON f.group_id = r.group_id AND f.type = r.type AND f.id = r.id AND f.prompt_text = r.prompt_text GROUP BY 1, 2""")
def _(t):
    return E.render_shared(t.items, groups(t), t.now)[1].select("group_id", "ticker", "refs")


@Q.add("f17_shared_evidence", "items", f"""
  WITH g AS {GROUPS}, r AS (SELECT i.*, g.group_id, g.group_pos FROM items i JOIN g ON g.ticker = i.ticker),
  f AS (SELECT group_id, type, id, prompt_text, row_number() OVER (PARTITION BY group_id ORDER BY min((group_pos, item_no))) AS e,
          arg_min({STAMP} || ' ' || prompt_text, (group_pos, item_no)) AS line FROM r GROUP BY 1, 2, 3, 4)
  SELECT group_id, string_agg('[E' || e || '] ' || line, chr(10) ORDER BY e) AS evidence FROM f GROUP BY 1""")
def _(t):
    return E.render_shared(t.items, groups(t), t.now)[0]


@Q.add("j23_evidence_overlap", "items", """SELECT a.ticker AS "left", b.ticker AS "right", CAST(sum(length(a.prompt_text)) AS BIGINT) AS weight FROM items a JOIN items b
  ON a.type = b.type AND a.id = b.id AND a.prompt_text = b.prompt_text AND a.ticker < b.ticker WHERE a.fanout >= 4 AND b.fanout >= 4 GROUP BY 1, 2""")
def _(t):
    return E.overlap(t.items)


@Q.add("j23_group_overlap", "items", """WITH i AS (SELECT *, ascii(substr(ticker, 1, 1)) % 3 AS group_id FROM items WHERE fanout >= 4)
  SELECT CAST(a.group_id AS INT) AS group_id, a.ticker AS "left", b.ticker AS "right", CAST(sum(length(a.prompt_text)) AS BIGINT) AS weight FROM i a JOIN i b
  ON a.group_id = b.group_id AND a.type = b.type AND a.id = b.id AND a.prompt_text = b.prompt_text AND a.ticker < b.ticker GROUP BY 1, 2, 3""")
def _(t):
    return E.overlap(t.items, groups(t))


@Q.add("s07_pick_quotes", "items", """SELECT ticker, quote_no, text FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY substance < 20, aside, fanout, likes DESC, item_no) AS quote_no,
  max(substance) OVER (PARTITION BY ticker) AS best FROM items) WHERE quote_no <= 3 AND (substance >= 20 OR best < 20)""")
def _(t):
    return E.pick_quotes(t.items)


@Q.add("s08_fallback_quotes", "items", """SELECT ticker, quote_no, text FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY type <> 'comment', item_no) AS quote_no,
  bool_or(type = 'comment') OVER (PARTITION BY ticker) AS any_comment FROM items) WHERE quote_no <= 3 AND (type = 'comment' OR NOT any_comment)""")
def _(t):
    return E.fallback_quotes(t.items)


@Q.add("c10_evidence_export", "items", f"SELECT ticker, item_no AS n, type, likes, greatest(0, ({NOW} - ts) // 3600000) AS age_hours, aside, fanout, prompt_text AS text FROM items")
def _(t):
    return E.export(t.items, t.now)


@Q.add("c16_detail_items", "items", f"SELECT ticker, item_no, type, text, likes, {NOW} - ts AS age_ms, coalesce(url, '') AS url, cluster_size FROM items WHERE item_no <= 30")
def _(t):
    return PB.detail_items(t.items, t.now).withColumn("url", F.coalesce("url", F.lit("")))


@Q.add("c16_detail_topics", "items topics", r"""SELECT ticker, array_to_string(list_sort(list(DISTINCT tag)), ',') AS topics FROM items i JOIN topics k ON
  CASE WHEN regexp_full_match(k.term, '[0-9a-z&.\- ]+') THEN contains(lower(i.text), k.term) AND regexp_matches(lower(i.text), '(^|[^0-9a-z])' || k.term || '([^0-9a-z]|$)') ELSE contains(lower(i.text), k.term) END
  WHERE item_no <= 30 GROUP BY 1""")
def _(t):
    return PB.detail_topics(t.items, t.dictionary).withColumn("topics", F.array_join("topics", ","))


# Sample submissions: one per entity, citing numbers partly out of range.


def submissions(t):
    k = t.items.select("ticker").distinct()
    return k.select(F.col("ticker").alias("submission_id"), "ticker", F.array(*[F.lit(i) for i in (3, 1, 3, 99, 2, 5)]).alias("ids"))


@Q.add("j19_quotes_from_ids", "items", """SELECT ticker AS submission_id, coalesce(string_agg(text, '|' ORDER BY CASE item_no WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END) FILTER (item_no IN (3, 1, 2)), '') AS quotes
  FROM items GROUP BY 1""")
def _(t):
    return QT.quotes_from_ids(submissions(t), t.items).select("submission_id", F.array_join("quotes", "|").alias("quotes"))


@Q.add("j20_verify_quotes", "items", f"""
  WITH qs AS (SELECT ticker, item_no, CASE WHEN item_no % 3 = 0 THEN upper(substr(text, 10, 40)) WHEN item_no % 3 = 1 THEN '!!' ELSE text || ' nope' END AS quote FROM items)
  SELECT ticker, item_no, {norm_hash('quote')} <> '' AND EXISTS (SELECT 1 FROM items i WHERE i.ticker = qs.ticker AND contains({norm_hash('i.text')}, {norm_hash('quote')})) AS kept FROM qs""")
def _(t):
    n = F.col("item_no")
    quote = F.when(n % 3 == 0, F.upper(F.substring("text", 10, 40))).when(n % 3 == 1, "!!").otherwise(F.concat("text", F.lit(" nope")))
    quotes = t.items.select(F.concat_ws("-", "ticker", n.cast("string")).alias("quote_id"), "ticker", n.alias("item_no"), quote.alias("quote"))
    return QT.verify_quotes(quotes, t.items).select("ticker", "item_no", "kept")


@Q.add("j20_corpus_quotes", "", f"""SELECT item_id, EXISTS (SELECT 1 FROM documents d WHERE contains({norm_hash('d.text')}, {norm_hash('b.text')})) AS kept FROM benchmark b""")
def _(t):
    quotes = t.raw("benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    texts = t.raw("documents").select(F.col("doc_id").alias("text_id"), "text")
    return QT.verify_corpus_quotes(quotes, texts).select(F.col("quote_id").alias("item_id"), "kept")


@Q.add("j20_quote_places", "", f"SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains({norm_hash('d.text')}, {norm_hash('b.text')})")
def _(t):
    quotes = t.raw("benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    texts = t.raw("documents").select(F.col("doc_id").alias("text_id"), "text")
    return QT.find_quotes(quotes, texts).select(F.col("quote_id").alias("item_id"), F.col("text_id").alias("doc_id"))


@Q.add("g17_search_hits", "notes0 comments0", "SELECT (SELECT count(*) FROM notes0 WHERE lower(title) LIKE '%thon%' OR lower(note_desc) LIKE '%thon%') AS note_hits, (SELECT count(*) FROM comments0 WHERE lower(content) LIKE '%thon%') AS comment_hits")
def _(t):
    return S.search(t.notes, t.comments, "tHon")["hits"]


@Q.add("g17_search_top", "notes0 comments0", """SELECT * FROM (SELECT note_id AS id, liked_count AS likes, substr(trim(title || ' ' || note_desc), 1, 300) AS text FROM notes0 WHERE lower(title) LIKE '%thon%' OR lower(note_desc) LIKE '%thon%' ORDER BY 2 DESC, 1 LIMIT 20)
  UNION ALL SELECT * FROM (SELECT comment_id, like_count, substr(content, 1, 200) FROM comments0 WHERE lower(content) LIKE '%thon%' ORDER BY 2 DESC, 1 LIMIT 20)""")
def _(t):
    r = S.search(t.notes, t.comments, "tHon")
    return r["notes"].unionByName(r["comments"])


CTX = "(" + " OR ".join(f"regexp_matches(x, '(^|[^0-9a-z]){w}([^0-9a-z]|$)')" for w in ("from", "tion", "avec")) + ")"
POOL = f"""SELECT row_number() OVER (ORDER BY likes DESC, note_id) AS item, * FROM (SELECT * FROM (
    SELECT note_id, liked_count AS likes, trim(title || ' ' || note_desc) AS full_text FROM notes n WHERE dup_group_id IS NULL
      AND NOT EXISTS (SELECT 1 FROM mentions m WHERE m.source_type = 'note' AND m.source_id = n.note_id) ORDER BY likes DESC, note_id LIMIT 200)
  WHERE {CTX.replace('(x,', '(lower(full_text),')} ORDER BY likes DESC, note_id LIMIT {{}})"""


@Q.add("c13_slang_candidates", "notes mentions", f"SELECT item, note_id, likes, substr(full_text, 1, 400) AS text FROM ({POOL.format(30)})")
def _(t):
    return S.candidates(t.notes, t.mentions, t.dictionary, t.now - t.context, 30).withColumn("text", F.substring("text", 1, S.SHOWN_CHARS))


@Q.add("s09_prefilter_then_quota", "notes mentions", f"SELECT item, note_id FROM ({POOL.format(5)})")
def _(t):
    return S.candidates(t.notes, t.mentions, t.dictionary, t.now - t.context, 5).select("item", "note_id")


SUG = """SELECT item_id % 9 AS item, split_part(text, ' ', CAST(item_id % 5 + 1 AS INT)) AS term, CASE WHEN item_id % 7 = 0 THEN 'bad1' ELSE 'abc' END AS ticker,
  CASE WHEN item_id % 2 = 0 THEN text ELSE '' END AS evidence FROM benchmark UNION ALL SELECT item, split_part(full_text, ' ', 3), 'xyz', substr(full_text, 5, 30) FROM pool"""


@Q.add("c14_vetted_suggestions", "notes mentions stocks", f"""
  WITH pool AS (SELECT *, full_text AS text FROM ({POOL.format(50)})), s AS ({SUG}),
  ok AS (SELECT *, upper(ticker) AS tk FROM s WHERE trim(term) <> '' AND regexp_full_match(upper(ticker), '[A-Z]{{1,5}}') AND upper(term) <> upper(ticker) AND {norm_hash('term')} <> ''
    AND lower(term) NOT IN (SELECT lower(unnest(list_concat([ticker], list_concat(aliases, ambiguous)))) FROM stocks)),
  f AS (SELECT ok.*, p.note_id, p.text AS ptext, row_number() OVER (PARTITION BY ok.item, ok.term, ok.tk, ok.evidence ORDER BY p.item <> ok.item, p.item) AS rn
    FROM (SELECT DISTINCT * FROM ok) ok JOIN pool p ON contains({norm_hash('p.text')}, {norm_hash('ok.term')}))
  SELECT DISTINCT term, tk AS guessed_ticker, note_id AS evidence_note_id, substr(CASE WHEN trim(evidence) <> '' AND contains({norm_hash('ptext')}, {norm_hash('evidence')}) THEN trim(evidence) ELSE ptext END, 1, 300) AS evidence_quote
  FROM f WHERE rn = 1""")
def _(t):
    pool = S.candidates(t.notes, t.mentions, t.dictionary, t.now - t.context)
    i = F.col("item_id")
    a = t.raw("benchmark").select((i % 9).cast("int").alias("item"), F.split_part("text", F.lit(" "), (i % 5 + 1).cast("int")).alias("term"),
                                  F.when(i % 7 == 0, "bad1").otherwise("abc").alias("ticker"), F.when(i % 2 == 0, F.col("text")).otherwise("").alias("evidence"))
    b = pool.select("item", F.split_part("text", F.lit(" "), F.lit(3)).alias("term"), F.lit("xyz").alias("ticker"), F.substring("text", 5, 30).alias("evidence"))
    return S.vet(a.unionByName(b), pool, t.dictionary, t.now).select("term", "guessed_ticker", "evidence_note_id", "evidence_quote").distinct()
