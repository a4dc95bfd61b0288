"""Boards, radar, sectors, candidates, compact board."""

from pyspark.sql import functions as F

from crowdgauge.operators import boards as B
from crowdgauge.operators.dictionary import classified
from crowdgauge.plans import board as PB

from .base import Registry
from .sqlparts import q, values

Q = Registry()
COLS = "ticker, score, mentions, focused_mentions"
OUT = ["ticker", "score", "mentions", "focused_mentions"]
OUTSIDE = "ticker NOT IN (SELECT ticker FROM classes WHERE is_non_stock)"
RANK = "mentions >= 2 AND focused_mentions >= 1"


@Q.add("s01_ranking", "stats classes", f"SELECT {COLS} FROM stats WHERE {OUTSIDE} AND {RANK} ORDER BY score DESC, ticker")
def _(t):
    return B.ranking(t.stats, t.outside).select(*OUT)


@Q.add("s01_radar", "fresh_stats classes", f"SELECT {COLS} FROM fresh_stats WHERE {OUTSIDE} AND mentions >= 1 AND NOT (mentions >= 90 AND focused_mentions >= 1) ORDER BY mentions DESC, score DESC, ticker")
def _(t):
    return B.radar(t.windows.filter("window = 'fresh'"), t.outside, 90).select(*OUT)


@Q.add("s02_class_board", "stats classes", f"SELECT {COLS} FROM stats WHERE ticker IN (SELECT ticker FROM classes WHERE is_index) AND mentions >= 2 ORDER BY score DESC, ticker")
def _(t):
    return B.class_board(t.stats, classified(t.dictionary.stocks).filter("is_index")).select(*OUT)


@Q.add("s03_context_radar", "stats fresh_stats classes tracked", f"""SELECT {COLS} FROM stats WHERE mentions >= 1 AND ticker NOT IN (
  SELECT ticker FROM fresh_stats WHERE mentions >= 90 UNION ALL SELECT ticker FROM tracked UNION ALL SELECT ticker FROM classes WHERE is_non_stock)""")
def _(t):
    fresh = t.windows.filter("window = 'fresh' AND mentions >= 90")
    return B.context_radar(t.windows.filter("window = 'context'"), B.shown(fresh, t.tracked, t.outside)).select(*OUT)


@Q.add("p04_rankable", "stats", f"SELECT ticker, {RANK} AS rankable FROM stats")
def _(t):
    return t.stats.select("ticker", B.is_rankable().alias("rankable"))


@Q.add("s04_candidates", "stats classes tracked", """
  WITH k AS (SELECT s.*, CASE WHEN c.is_index THEN 'index' WHEN c.is_investment THEN 'investment' ELSE 'stock' END AS kind FROM stats s LEFT JOIN classes c ON c.ticker = s.ticker),
  top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, ticker) AS rank FROM k WHERE mentions >= 2 AND (kind <> 'stock' OR focused_mentions >= 1))
          WHERE rank <= CASE kind WHEN 'stock' THEN 4 WHEN 'index' THEN 1 ELSE 1 END)
  SELECT CASE kind WHEN 'stock' THEN 0 WHEN 'index' THEN 1 ELSE 2 END AS section, rank, ticker, kind, score, mentions FROM top
  UNION ALL SELECT 3, row_number() OVER (ORDER BY ticker), ticker, kind, score, mentions FROM k WHERE mentions >= 1
    AND ticker IN (SELECT ticker FROM tracked) AND ticker NOT IN (SELECT ticker FROM top)""")
def _(t):
    return B.candidates(t.stats, t.dictionary.stocks, t.tracked, 2, {"stock": 4, "index": 1, "investment": 1})


@Q.add("s05_tracked_boards", "stats classes tracked", f"""
  SELECT ticker, board, score, mentions, is_tracked AS tracked FROM (
    SELECT coalesce(s.ticker, w.ticker) AS ticker, coalesce(score, 0) AS score, coalesce(mentions, 0) AS mentions, coalesce(focused_mentions, 0) AS f,
           w.ticker IS NOT NULL AS is_tracked, CASE WHEN c.is_investment THEN 'investments' WHEN c.is_index THEN 'indexes' ELSE 'ranking' END AS board
    FROM stats s FULL JOIN tracked w ON w.ticker = s.ticker LEFT JOIN classes c ON c.ticker = coalesce(s.ticker, w.ticker))
  WHERE is_tracked OR (mentions >= 2 AND (board <> 'ranking' OR f >= 1))""")
def _(t):
    return B.boards_with_tracked(t.stats, t.dictionary.stocks, t.tracked).select("ticker", "board", "score", "mentions", "tracked")


@Q.add("t02_shown_set", "fresh_stats tracked classes", "SELECT ticker FROM fresh_stats UNION SELECT ticker FROM tracked UNION SELECT ticker FROM classes WHERE is_non_stock")
def _(t):
    return B.shown(t.windows.filter("window = 'fresh'"), t.tracked, t.outside)


@Q.add("g09_sectors", "stats classes", """
  WITH a AS (SELECT coalesce(nullif(c.sector, ''), '其他') AS sector, s.* FROM stats s LEFT JOIN classes c ON c.ticker = s.ticker WHERE mentions >= 1 AND NOT coalesce(c.is_non_stock, false)),
  g AS (SELECT sector, sum(score) AS raw, sum(mentions)::BIGINT AS mentions, count(*) AS tickers, max(score) AS leader_score FROM a GROUP BY 1)
  SELECT sector, round(raw, 2) AS score, mentions, tickers, (SELECT min(ticker) FROM a WHERE a.sector = g.sector AND a.score = g.leader_score) AS leader, leader_score,
    round(round(raw, 2) / sum(raw) OVER () * 100, 1) AS share FROM g""")
def _(t):
    return B.sector_breakdown(t.stats, t.dictionary.stocks, t.outside)


@Q.add("p14_chart_rows", "snaps ana", """SELECT s.ticker, s.score, s.mentions, CASE WHEN a.run_id % 7 = 0 THEN 'neut' WHEN a.bull > a.bear THEN 'bull' WHEN a.bull < a.bear THEN 'bear' ELSE 'neut' END AS sign,
  coalesce(1706400000000 - a.generated_at_ms > 21600000, false) AS stale
  FROM (SELECT 'U' || CAST(CAST('0x' || substr(md5(ticker || '-' || CAST(snapped_at_ms AS VARCHAR)), 1, 8) AS BIGINT) % 11 AS VARCHAR) AS ticker, score, mentions FROM snaps) s
  LEFT JOIN (SELECT * FROM ana WHERE run_id = (SELECT max(run_id) FROM ana)) a ON a.ticker = s.ticker WHERE s.mentions > 0""")
def _(t):
    digits = F.substring(F.md5(F.concat_ws("-", "ticker", F.col("snapped_at_ms").cast("string"))), 1, 8)
    n = F.conv(digits, 16, 10).cast("long") % 11
    s = t.snapshots.select(F.concat(F.lit("U"), n.cast("string")).alias("ticker"), "score", "mentions")
    a = t.analyses
    last = a.agg(F.max("run_id").alias("m")).scalar()
    return B.chart_rows(s, a.withColumn("_m", last).filter("run_id = _m"), 1706400000000)


@Q.add("c05_compact_board", "stats classes stocks", f"""
  SELECT section, b.ticker, score, mentions, note_count, comment_count, coalesce(s.name, '') AS name FROM (
    SELECT 'stocks' AS section, * FROM stats WHERE {OUTSIDE} AND {RANK}
    UNION ALL SELECT 'indexes', * FROM stats WHERE ticker IN (SELECT ticker FROM classes WHERE is_index) AND mentions >= 2
    UNION ALL SELECT 'investments', * FROM stats WHERE ticker IN (SELECT ticker FROM classes WHERE is_investment) AND mentions >= 2
    UNION ALL SELECT 'radar', * FROM (SELECT * FROM stats WHERE {OUTSIDE} AND mentions >= 1 AND NOT ({RANK}) ORDER BY mentions DESC, score DESC, ticker LIMIT 15)) b
  LEFT JOIN stocks s ON s.ticker = b.ticker""")
def _(t):
    return PB.compact(t.stats, t.dictionary)


# Cards need analyses, quotes and snapshots of the same tickers: the event-derived tables renamed
# by a fixed map from their keys to dictionary tickers.
MAP = {"U0": "THN", "U1": "ERN", "U2": "ANE", "U3": "DER", "U4": "UNE", "U5": "NG", "U6": "BRK", "U7": "ERA"}
SNAP = {"CLI0": "THN", "CLI1": "ERN", "ERR0": "ANE", "PUR0": "DER", "SIG1": "UNE", "VIE2": "BRK"}


def renamed(t, df, names):
    from crowdgauge.session import small_table
    m = small_table(t.spark, names.items(), "ticker string, to string")
    return df.join(m, "ticker").drop("ticker").withColumnRenamed("to", "ticker")


def vals(names):
    return values([(q(a), q(b)) for a, b in names.items()], "a, b")


def board_inputs(t):
    from crowdgauge.operators.prices import latest_quotes
    ana = renamed(t, t.analyses.withColumn("sentiment_counts", F.when(F.col("run_id") % 7 != 0, F.col("sentiment_counts"))), MAP)
    quotes = latest_quotes(renamed(t, t.prices, MAP), t.now)
    return ana, quotes, renamed(t, t.snapshots, SNAP)


TREND = """(WITH c AS (SELECT DISTINCT snapped_at_ms AS at_ms FROM {s} ORDER BY 1 DESC LIMIT 2)
  SELECT n.ticker, n.score, p.score AS p, CASE WHEN p.score IS NULL THEN 'new'
    WHEN p.score > 0 AND (n.score - p.score) / p.score * 100 >= 25 AND n.score - p.score >= 2 THEN 'up'
    WHEN p.score > 0 AND (n.score - p.score) / p.score * 100 <= -25 AND p.score - n.score >= 2 THEN 'down' ELSE 'flat' END AS dir
  FROM {s} n LEFT JOIN {s} p ON p.ticker = n.ticker AND p.snapped_at_ms = (SELECT min(at_ms) FROM c)
  WHERE n.snapped_at_ms = (SELECT max(at_ms) FROM c) AND (SELECT count(*) FROM c) = 2)"""


@Q.add("c04_board_cards", "stats fresh_stats classes tracked ana px snaps", f"""
  WITH am AS (SELECT m.b AS ticker, a.* EXCLUDE (ticker) FROM ana a JOIN ({vals(MAP)}) m ON m.a = a.ticker),
  la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY CASE WHEN status IN ('ok','no_api_key') THEN 0 ELSE 1 END, rn) AS pick FROM (
    SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY generated_at_ms DESC) AS rn FROM am) WHERE rn <= 5) WHERE pick = 1),
  pm AS (SELECT m.b AS ticker, p.date, p.close, row_number() OVER (PARTITION BY m.b ORDER BY p.date DESC) AS rn FROM px p JOIN ({vals(MAP)}) m ON m.a = p.ticker),
  qt AS (SELECT ticker, max(close) FILTER (rn = 1) AS price, max(close) FILTER (rn = 2) AS prev FROM pm WHERE rn <= 2 GROUP BY 1),
  sm AS (SELECT m.b AS ticker, s.* EXCLUDE (ticker) FROM snaps s JOIN ({vals(SNAP)}) m ON m.a = s.ticker),
  tr AS {TREND.format(s='sm')},
  hi AS (SELECT ticker, count(*) AS n, round(sum(score), 2) AS total FROM sm WHERE snapped_at_ms IN (SELECT DISTINCT snapped_at_ms FROM sm ORDER BY 1 DESC LIMIT 30) GROUP BY 1),
  ncyc AS (SELECT least(30, count(DISTINCT snapped_at_ms)) AS n FROM sm),
  bd AS (SELECT ticker, board, score, mentions, is_tracked FROM (
    SELECT coalesce(s.ticker, w.ticker) AS ticker, coalesce(score, 0) AS score, coalesce(mentions, 0) AS mentions, coalesce(focused_mentions, 0) AS f,
           w.ticker IS NOT NULL AS is_tracked, CASE WHEN c.is_investment THEN 'investments' WHEN c.is_index THEN 'indexes' ELSE 'ranking' END AS board
    FROM fresh_stats s FULL JOIN tracked w ON w.ticker = s.ticker LEFT JOIN classes c ON c.ticker = coalesce(s.ticker, w.ticker))
  WHERE is_tracked OR (mentions >= 2 AND (board <> 'ranking' OR f >= 1)))
  SELECT b.ticker, b.board, b.score, b.mentions, b.is_tracked AS tracked, coalesce(c.asset_class, 'stock') AS asset_class, la.status AS analysis_status,
    {{now}} - la.generated_at_ms AS analysis_age_ms, qt.price, CASE WHEN qt.prev <> 0 THEN round((qt.price - qt.prev) / qt.prev * 100, 2) END AS change_pct, tr.dir AS trend,
    (SELECT n FROM ncyc) AS history_points, coalesce(hi.total, 0.0) AS history_total,
    coalesce(la.run_id % 7 <> 0 AND ((la.bull - la.bear >= 2 AND round((qt.price - qt.prev) / qt.prev * 100, 2) <= -2) OR (la.bull - la.bear <= -2 AND round((qt.price - qt.prev) / qt.prev * 100, 2) >= 2)), false) AS divergence
  FROM bd b LEFT JOIN classes c ON c.ticker = b.ticker LEFT JOIN la ON la.ticker = b.ticker LEFT JOIN qt ON qt.ticker = b.ticker
  LEFT JOIN tr ON tr.ticker = b.ticker LEFT JOIN hi ON hi.ticker = b.ticker""".replace("{now}", "1706572800000"))
def _(t):
    ana, quotes, snaps = board_inputs(t)
    p = PB.payload(t.windows, t.notes, t.dictionary, t.tracked, t.now, ana, quotes, snaps)
    total = F.round(F.aggregate("history", F.lit(0.0), lambda a, x: a + x["score"]), 2)
    return p["cards"].select(
        "ticker", "board", "score", "mentions", "tracked", "asset_class", "analysis_status", "analysis_age_ms", "price", "change_pct", "trend",
        F.size("history").cast("bigint").alias("history_points"), total.alias("history_total"), "divergence")


@Q.add("c04_board_radar", "stats fresh_stats classes tracked stocks", f"""
  SELECT x.ticker, s.name, x.mentions, x.score FROM stats x LEFT JOIN stocks s ON s.ticker = x.ticker WHERE mentions >= 1 AND x.ticker NOT IN (
    SELECT ticker FROM fresh_stats WHERE {OUTSIDE} AND mentions >= 100 AND focused_mentions >= 1
    UNION ALL SELECT ticker FROM tracked UNION ALL SELECT ticker FROM classes WHERE is_non_stock)""")
def _(t):
    ana, quotes, snaps = board_inputs(t)
    return PB.payload(t.windows, t.notes, t.dictionary, t.tracked, t.now, ana, quotes, snaps, min_mentions=100)["radar"].select("ticker", "name", "mentions", "score")
