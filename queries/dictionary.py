"""Dictionary operators over a dictionary derived from the part and customer tables."""

from dataclasses import replace

from pyspark.sql import functions as F

from crowdgauge.operators import dictionary as D
from crowdgauge.operators import suggestions as S
from crowdgauge.operators import tables as TB

from .base import Registry
from .sqlparts import tracked_queries

Q = Registry()
WORDS = "['widget', 'seg 1']"


def listed(df):
    return df.select("ticker", "name", "sector", F.array_join("aliases", "|").alias("aliases"), F.array_join("ambiguous", "|").alias("ambiguous"))


def dedup_list(e):
    return f"array_to_string(list_filter({e}, lambda x, i: list_position({e}, x) = i), '|')"


MERGED = f"""SELECT coalesce(b.ticker, o.ticker) AS ticker, CASE WHEN b.ticker IS NULL THEN o.name ELSE b.name END AS name,
  CASE WHEN b.ticker IS NULL THEN o.sector ELSE b.sector END AS sector,
  {dedup_list("list_concat(coalesce(b.aliases, []::VARCHAR[]), coalesce(o.aliases, []::VARCHAR[]))")} AS aliases,
  {dedup_list("list_concat(coalesce(b.ambiguous, []::VARCHAR[]), coalesce(o.ambiguous, []::VARCHAR[]))")} AS ambiguous
  FROM pstocks b FULL JOIN pover o ON b.ticker = o.ticker"""


@Q.add("a10_overlay_merge", "pstocks pover", MERGED)
def _(t):
    return listed(D.merge_overlay(t.part_stocks, t.part_overlay))


def worded(t, word, parts, every):
    """A dictionary of parts: a word of each name, and every so manieth part a collision."""
    p = t.raw("part").filter(parts)
    return replace(t.dictionary, stocks=t.part_stocks, context_words=p.select(F.split("p_name", " ")[word].alias("word")).filter("word is not null").distinct(),
                   collisions=p.filter(F.col("p_size") % every == 0).select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("ticker")))


@Q.add("a10_overlay_words", "", """SELECT 'word' AS kind, w AS value FROM (SELECT string_split(p_name, ' ')[1] AS w FROM part WHERE p_partkey % 2 = 0 UNION SELECT string_split(p_name, ' ')[2] FROM part WHERE p_partkey % 3 = 0) WHERE w IS NOT NULL
  UNION ALL SELECT 'collision', 'P' || p_partkey FROM part WHERE (p_partkey % 2 = 0 AND p_size % 5 = 0) OR (p_partkey % 3 = 0 AND p_size % 3 = 0)
  UNION ALL SELECT 'trap', 'anea' UNION ALL SELECT 'trap', 'erin of' UNION ALL SELECT 'trap', 'thon the'""")
def _(t):
    both = worded(t, 0, "p_partkey % 2 = 0", 5).merged(worded(t, 1, "p_partkey % 3 = 0", 3))
    return both.context_words.select(F.lit("word").alias("kind"), F.col("word").alias("value")).unionByName(
        both.collisions.select(F.lit("collision").alias("kind"), F.col("ticker").alias("value"))).unionByName(
        both.traps.select(F.lit("trap").alias("kind"), F.col("phrase").alias("value")))


@Q.add("t03_ordered_union", "pstocks pover", f"SELECT ticker, aliases FROM ({MERGED})")
def _(t):
    return listed(D.merge_overlay(t.part_stocks, t.part_overlay)).select("ticker", "aliases")


ACCEPTED = "SELECT guessed_ticker AS ticker, list_sort(list(DISTINCT term)) AS terms FROM sugg WHERE status = 'pending' GROUP BY 1"


@Q.add("a11_overlay_append", "pover sugg", f"""
  SELECT coalesce(o.ticker, a.ticker) AS ticker, coalesce(o.name, '') AS name,
    {dedup_list("list_concat(coalesce(o.ambiguous, []::VARCHAR[]), coalesce(a.terms, []::VARCHAR[]))")} AS ambiguous
  FROM pover o FULL JOIN ({ACCEPTED}) a ON a.ticker = o.ticker""")
def _(t):
    acc = t.suggestions.filter("status = 'pending'").select("term", F.col("guessed_ticker").alias("ticker"))
    return D.add_aliases(t.part_overlay, acc).select("ticker", "name", F.array_join("ambiguous", "|").alias("ambiguous"))


CLS = "coalesce(nullif(asset_class, ''), CASE WHEN sector = 'ETF指数' THEN 'index' ELSE 'stock' END)"


@Q.add("p03_asset_class", "pstocks", f"""SELECT ticker, c AS asset_class, c = 'index' AS is_index, c IN ('commodity','bond','fund','crypto','forex') AS is_investment,
  c IN ('index','commodity','bond','fund','crypto','forex') AS is_non_stock FROM (SELECT ticker, {CLS} AS c FROM pstocks)""")
def _(t):
    return D.classified(t.part_stocks).select("ticker", "asset_class", "is_index", "is_investment", "is_non_stock")


@Q.add("p10_quoteable", "pstocks", f"""SELECT ticker, c AS asset_class, coalesce(quote_symbol, ticker) AS symbol FROM (SELECT *, {CLS} AS c FROM pstocks)
  WHERE c IN ('stock', 'index') OR quote_symbol IS NOT NULL""")
def _(t):
    return D.quoteable(t.part_stocks)


@Q.add("t04_known_terms", "pstocks", "SELECT DISTINCT lower(unnest(list_concat([ticker], list_concat(aliases, ambiguous)))) AS term FROM pstocks")
def _(t):
    return D.known_terms(t.part_stocks)


@Q.add("f15_tracked_queries", "ctracked pstocks", f"SELECT query_key, query, ticker FROM ({tracked_queries('ctracked', 'pstocks', WORDS)})")
def _(t):
    from crowdgauge.session import small_table
    d = t.dictionary
    own = D.Dictionary(t.part_stocks, small_table(t.spark, [("widget",), ("seg 1",)], "word string"), d.collisions, d.traps, d.topics)
    return D.tracked_queries(own, t.customer_tracked)


CHANGES = """SELECT CASE WHEN s_suppkey % 9 = 0 THEN 'x1' ELSE chr(CAST(65 + s_suppkey % 26 AS INT)) || chr(CAST(65 + s_suppkey % 7 AS INT)) END AS ticker,
  CASE WHEN s_suppkey % 3 = 0 THEN 'delete' ELSE 'add' END AS action, s_name AS kw, s_suppkey AS req FROM supplier"""
OLD = "SELECT chr(CAST(65 + n_nationkey AS INT)) || chr(CAST(65 + n_nationkey % 7 AS INT)) AS ticker, n_nationkey AS added_at_ms, '[\"old\"]' AS custom_keywords FROM nation"


def watch(t):
    s = F.col("s_suppkey")
    pair = F.concat(F.char(65 + s % 26), F.char(65 + s % 7))
    changes = t.raw("supplier").select(
        F.when(s % 9 == 0, " x1").otherwise(F.lower(pair)).alias("ticker"), F.when(s % 3 == 0, "delete").otherwise("add").alias("action"),
        F.concat(F.lit(" "), "s_name", F.lit(",")).alias("custom_keywords"), s.alias("requested_at_ms"))
    k = F.col("n_nationkey")
    old = t.raw("nation").select(F.concat(F.char(65 + k), F.char(65 + k % 7)).alias("ticker"), k.cast("bigint").alias("added_at_ms"), F.lit('["old"]').alias("custom_keywords"))
    return old, changes


@Q.add("a14_watch_list", "", f"""
  WITH last AS (SELECT ticker, arg_max(action, req) AS action, arg_max(kw, req) AS kw, max(req) AS req FROM ({CHANGES}) WHERE ticker <> 'x1' GROUP BY 1), old AS ({OLD})
  SELECT coalesce(o.ticker, l.ticker) AS ticker, coalesce(o.added_at_ms, l.req) AS added_at_ms,
    CASE WHEN l.action = 'add' THEN '["' || l.kw || '"]' ELSE o.custom_keywords END AS custom_keywords
  FROM old o FULL JOIN last l ON l.ticker = o.ticker WHERE coalesce(l.action, 'add') <> 'delete'""")
def _(t):
    return TB.apply_watch_list(*watch(t))


@Q.add("a18_suggest_alias", "sugg", """
  WITH p AS (SELECT DISTINCT lower(p_name) AS term, 'P' || (p_partkey % 50) AS guessed_ticker FROM part
             UNION SELECT term, guessed_ticker FROM sugg WHERE id % 2 = 0)
  SELECT p.term, p.guessed_ticker, CASE WHEN EXISTS (SELECT 1 FROM sugg s WHERE s.term = p.term AND s.guessed_ticker = p.guessed_ticker)
    THEN 'already_suggested' ELSE 'ok' END AS status FROM p""")
def _(t):
    a = t.raw("part").select(F.concat(F.lit(" "), F.lower("p_name")).alias("term"), F.concat(F.lit("p"), (F.col("p_partkey") % 50).cast("string")).alias("ticker"), F.lit("e").alias("evidence_quote"))
    b = t.suggestions.filter("id % 2 = 0").select("term", F.col("guessed_ticker").alias("ticker"), F.lit("e").alias("evidence_quote"))
    return S.suggest(t.suggestions, a.unionByName(b), 5).select("term", "guessed_ticker", "status")


@Q.add("a06_insert_absent", "sugg", """SELECT DISTINCT lower(p_type) AS term, 'P' || (p_partkey % 90) AS guessed_ticker FROM part
  EXCEPT SELECT term, guessed_ticker FROM sugg""")
def _(t):
    new = t.raw("part").select(F.lower("p_type").alias("term"), F.concat(F.lit("P"), (F.col("p_partkey") % 90).cast("string")).alias("guessed_ticker"), F.col("p_partkey").alias("id"))
    return TB.insert_absent(t.suggestions, new, ["term", "guessed_ticker"]).select("term", "guessed_ticker")


@Q.add("c15_suggestion_review", "sugg", """SELECT id, term, guessed_ticker, CASE WHEN id % 4 = 0 THEN 'accepted' WHEN id % 4 = 1 THEN 'rejected' ELSE status END AS status FROM sugg""")
def _(t):
    d = t.suggestions.select("id", F.when(F.col("id") % 4 == 0, "accept").when(F.col("id") % 4 == 1, "reject").otherwise("later").alias("action"), F.lit(1).alias("decided_at_ms"))
    return TB.review_suggestions(t.suggestions, d).select("id", "term", "guessed_ticker", "status")


@Q.add("s10_suggestion_listing", "sugg", "SELECT id, term, suggested_at_ms FROM sugg WHERE status = 'pending' ORDER BY suggested_at_ms DESC, id LIMIT 100")
def _(t):
    return TB.listing(t.suggestions, "pending", 100).select("id", "term", "suggested_at_ms")
