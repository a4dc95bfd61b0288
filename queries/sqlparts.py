"""Named SQL parts over the test tables. ``sql(needs, body)`` prepends what a query uses."""

from __future__ import annotations

from crowdgauge import constants as K
from crowdgauge import fixtures as X
from crowdgauge.sources.corpus import AGE_MINUTES, CONTEXT_MS, FRESH_MS, NOW_MS

CUT = NOW_MS - CONTEXT_MS
FRESH_CUT = NOW_MS - FRESH_MS
SP = r"[\s\x1c-\x1f\x{85}\x{a0}]+"


def q(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]::VARCHAR[]"


def values(rows, columns: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(
        "(" + ", ".join(v if isinstance(v, str) else str(v) for v in row) + ")" for row in rows
    ) + f") AS v({columns})"


# ---- text functions as SQL templates ----

def squeeze(x): return f"trim(regexp_replace(coalesce({x}, ''), '{SP}', ' ', 'g'))"


def note_text(t, d):
    a, b = squeeze(t), squeeze(d)
    return f"(CASE WHEN {a} <> '' AND starts_with({b}, {a}) THEN {b} ELSE trim({a} || ' ' || {b}) END)"


def clean_tags(x): return squeeze(rf"regexp_replace(coalesce({x}, ''), '\[话题\]#', ' ', 'g')")
def strip_hashtags(x): return rf"regexp_replace(coalesce({x}, ''), '#[^#\n]{{0,40}}\[话题\]#', ' ', 'g')"
def norm_hash(x): return f"regexp_replace(lower(coalesce({x}, '')), '[^0-9a-z一-鿿]+', '', 'g')"


def substance(x):
    s = f"coalesce({x}, '')"
    for p in (r"https?://\S+", r"#[^#\n]{0,40}\[话题\]#|#[^\s#]{1,30}", r"@[^\s@]{1,20}", r"\[[^\[\]\n]{1,12}\]"):
        s = f"regexp_replace({s}, '{p}', ' ', 'g')"
    s = f"regexp_replace({s}, '[^0-9a-zA-Z一-鿿]+', '', 'g')"
    return f"(length({s}) + length(regexp_replace({s}, '[^一-鿿]', '', 'g')))"


def is_latin(a): return rf"regexp_full_match(lower({a}), '[0-9a-z&.\- ]+')"


def has_term(low, a):
    return (f"(contains({low}, lower({a})) AND (NOT {is_latin(a)} OR "
            f"regexp_matches({low}, '(^|[^0-9a-z])' || lower({a}) || '([^0-9a-z]|$)')))")


def term_count(x, a):
    """Boundary characters are doubled so that neighbouring mentions do not share one."""
    low = f"lower(coalesce({x}, ''))"
    spaced = f"regexp_replace({low}, '([^0-9a-z])', '\\1\\1', 'g')"
    wide = f"regexp_replace(lower({a}), '([^0-9a-z])', '\\1\\1', 'g')"
    return (f"(CASE WHEN {is_latin(a)} THEN len(regexp_extract_all({spaced}, '(?:^|[^0-9a-z])' || {wide} || '(?:[^0-9a-z]|$)')) "
            f"ELSE (length({low}) - length(replace({low}, lower({a}), ''))) // length({a}) END)")


def term_pos(x, a):
    low = f"lower(coalesce({x}, ''))"
    return (f"(CASE WHEN {is_latin(a)} THEN CASE WHEN regexp_matches({low}, '(^|[^0-9a-z])' || lower({a}) || '([^0-9a-z]|$)') "
            f"THEN length(regexp_extract({low}, '^((?s:.*?)(?:^|[^0-9a-z]))' || lower({a}) || '(?:[^0-9a-z]|$)', 1)) ELSE -1 END "
            f"ELSE instr({low}, lower({a})) - 1 END)")


def excerpt(x, p, w=K.NOTE_TRUNC):
    start = f"greatest({K.HEAD_KEEP}, {p} - {w // 4})"
    n = w - K.HEAD_KEEP
    return (f"(CASE WHEN {p} < 0 OR {p} + {K.MENTION_TAIL} <= {w} THEN substr({x}, 1, {w}) ELSE "
            f"rtrim(rtrim(substr({x}, 1, {K.HEAD_KEEP})) || '…' || substr({x}, {start} + 1, {n})) || "
            f"CASE WHEN {start} + {n} < length({x}) THEN '…' ELSE '' END END)")


# ---- dictionary rows ----

def _terms():
    rows = []
    stocks = {s[0]: s for s in X.STOCKS}
    extra = {t: k for t, _, k in X.TRACKED}
    import json
    for t in dict.fromkeys([*stocks, *extra]):
        s = stocks.get(t)
        safe = s[4] if s else []
        amb = list(s[5]) if s else []
        for k in json.loads(extra.get(t) or "[]"):
            if k and k not in amb:
                amb.append(k)
        sup = s[6] if s else []
        groups = [("safe", safe), ("ambiguous", amb), ("symbol", [t] if len(t) >= 2 else [])]
        for kind, names in groups:
            for i, a in enumerate(names):
                ordn = -1 if kind == "symbol" else i
                coll = "true" if t in X.COLLISIONS else "false"
                rows.append((q(kind), q(a if kind == "symbol" else a.lower()), q(t), q(a), ordn, coll, arr(sup)))
    for w in X.CONTEXT_WORDS:
        rows.append(("'context'", q(w.lower()), "NULL", q(w), 0, "false", arr([])))
    return values(rows, "kind, term, ticker, alias, ord, collision, supersedes")


def _masked(x):
    s = f"lower({x})"
    for t in X.TRAPS:
        s = f"replace({s}, {q(t.lower())}, {q('~' * len(t))})"
    return s


def tracked_queries(tracked: str, stocks: str, words: str) -> str:
    """SQL of the search queries of tracked tickers; ``words`` is a list expression."""
    qual = f"CASE WHEN len(list_filter({words}, lambda w: contains(lower(%s), w))) > 0 THEN %s ELSE %s || ' {K.QUERY_QUALIFIER}' END"
    a1, k = qual % (("s.ambiguous[1]",) * 3), qual % (("k",) * 3)
    return f"""
    SELECT lower(query) AS query_key, arg_min(query, (ticker, pos)) AS query, min(ticker) AS ticker FROM (
      SELECT ticker, unnest(qs) AS query, generate_subscripts(qs, 1) - 1 AS pos FROM (
        SELECT t.ticker, list_concat(list_concat([t.ticker],
          CASE WHEN len(s.aliases) > 0 THEN [s.aliases[1]] WHEN len(s.ambiguous) > 0 THEN [{a1}] ELSE [] END),
          list_transform(list_filter(coalesce(from_json(t.custom_keywords, '["VARCHAR"]'), []), lambda k: k <> ''), lambda k: {k})) AS qs
        FROM {tracked} t LEFT JOIN {stocks} s ON s.ticker = t.ticker))
    GROUP BY 1"""


PARTS: dict[str, tuple[str, str]] = {}


def part(name: str, needs: str, body: str) -> None:
    PARTS[name] = (needs, body)


part("stocks", "", values(
    [(q(s[0]), q(s[1]), q(s[2]), q(s[3]), arr(s[4]), arr(s[5]), arr(s[6]), q(s[7])) for s in X.STOCKS],
    "ticker, name, sector, asset_class, aliases, ambiguous, supersedes, quote_symbol"))
part("classes", "stocks", f"""
  SELECT ticker, name, sector, cls AS asset_class, cls = 'index' AS is_index,
         cls IN ('commodity','bond','fund','crypto','forex') AS is_investment,
         cls IN ('index','commodity','bond','fund','crypto','forex') AS is_non_stock, quote_symbol
  FROM (SELECT *, coalesce(nullif(asset_class, ''), CASE WHEN sector = '{K.INDEX_SECTOR}' THEN 'index' ELSE 'stock' END) AS cls FROM stocks)""")
part("tracked", "", values([(q(t), n, q(k)) for t, n, k in X.TRACKED], "ticker, added_at_ms, custom_keywords"))
part("terms", "", _terms())
part("track_q", "tracked stocks", tracked_queries("tracked", "stocks", arr([w.lower() for w in X.CONTEXT_WORDS])))
part("topics", "", values([(i, q(t), q(a.lower())) for i, (t, al) in enumerate(X.TOPICS) for a in al], "ord, tag, term"))
AGE = f"{NOW_MS} - ({{}} * 7919 % {AGE_MINUTES}) * 60000"
part("notes0", "", f"""
  SELECT CAST(doc_id AS VARCHAR) AS note_id, split_part(text, chr(10), 1) AS title, text AS note_desc,
         {AGE.format('doc_id')} AS publish_time_ms, (doc_id * 131) % 1000 AS liked_count,
         '/n/' || CAST(doc_id AS VARCHAR) AS note_url, '#' || lang || '[话题]#' AS tag_list,
         source AS source_keyword, doc_id % 3 + 1 AS last_seen_run_id, {norm_hash('text')} AS norm
  FROM documents""")
part("comments0", "", f"""
  SELECT conv_id || '-' || turn AS comment_id, CAST(conv_id AS VARCHAR) AS note_id,
         CASE WHEN turn > 0 THEN conv_id || '-0' END AS parent_comment_id, text AS content,
         {AGE.format('conv_id')} + (turn + 1) * 60000 AS create_time_ms, (conv_id * 31 + turn * 17) % 100 AS like_count,
         CASE WHEN length({norm_hash('text')}) >= 8 THEN {norm_hash('text')} END AS norm
  FROM conversations""")


def _mark(src, key, likes, time):
    first = f"first_value({key}) OVER (PARTITION BY norm ORDER BY {likes} DESC, {time}, {key})"
    return (f"SELECT *, CASE WHEN norm IS NOT NULL AND {time} >= {CUT} AND {first} <> {key} THEN {first} END AS dup_group_id "
            f"FROM {src}")


part("notes", "notes0", _mark("notes0", "note_id", "liked_count", "publish_time_ms"))
part("comments", "comments0", _mark("comments0", "comment_id", "like_count", "create_time_ms"))
part("texts", "notes0 comments0 track_q", f"""
  SELECT x.*, k.ticker AS targeted, {_masked('raw')} AS low FROM (
    SELECT 'note' AS source_type, note_id AS source_id, note_id, coalesce(title,'') || chr(10) || coalesce(note_desc,'') AS raw,
           publish_time_ms AS content_time_ms, source_keyword FROM notes0 WHERE publish_time_ms >= {CUT}
    UNION ALL
    SELECT 'comment', c.comment_id, c.note_id, coalesce(c.content,''), c.create_time_ms, n.source_keyword
    FROM comments0 c JOIN notes0 n ON n.note_id = c.note_id WHERE c.create_time_ms >= {CUT}) x
  LEFT JOIN track_q k ON k.query_key = lower(trim(coalesce(x.source_keyword, '')))""")
part("hits", "texts terms", r"""
  SELECT t.source_type, t.source_id, t.note_id, t.content_time_ms, t.targeted, k.* FROM texts t JOIN terms k ON
    CASE WHEN k.kind = 'symbol' THEN contains(t.raw, k.term) AND regexp_matches(t.raw, '(^|[^A-Za-z0-9])' || k.term || '([^A-Za-z0-9]|$)')
         ELSE """ + has_term("t.low", "k.term") + " END")
part("mentions", "hits", """
  SELECT ticker, source_type, source_id, note_id, matched_alias, match_basis, content_time_ms, CAST(7 AS BIGINT) AS run_id FROM (
    SELECT *, list_contains(flatten(list(supersedes) OVER (PARTITION BY source_type, source_id)), ticker) AS gone FROM (
      SELECT *, alias AS matched_alias, row_number() OVER (PARTITION BY source_type, source_id, ticker ORDER BY
         CASE match_basis WHEN 'safe_alias' THEN 4 WHEN 'ticker_symbol' THEN 3 WHEN 'alias+context' THEN 2 ELSE 1 END DESC, ord, alias) AS rn
      FROM (SELECT *, CASE WHEN kind = 'safe' THEN 'safe_alias'
                 WHEN kind = 'symbol' AND (NOT collision OR ctx) THEN 'ticker_symbol'
                 WHEN kind = 'ambiguous' AND ctx THEN 'alias+context'
                 WHEN targeted = ticker THEN 'targeted_search' END AS match_basis
            FROM (SELECT *, bool_or(kind = 'context') OVER (PARTITION BY source_type, source_id) AS ctx FROM hits)
            WHERE kind <> 'context') WHERE match_basis IS NOT NULL) WHERE rn = 1) WHERE NOT gone""")


def stats_sql(cut: int) -> str:
    body = clean_tags(note_text("n.title", "n.note_desc"))
    prose = f"lower({strip_hashtags('coalesce(n.title, %s) || chr(10) || coalesce(n.note_desc, %s)' % (chr(39) * 2, chr(39) * 2))})"
    return f"""
  SELECT ticker, count(*) FILTER (note AND can) AS note_count, count(*) FILTER (NOT note AND can) AS comment_count,
         count(*) FILTER (note) AS note_count_raw, count(*) FILTER (NOT note) AS comment_count_raw,
         count(*) FILTER (can AND focused) AS focused_mentions, count(*) FILTER (can) AS mentions,
         round(3.0 * coalesce(sum(w) FILTER (note AND can), 0) + coalesce(sum(w) FILTER (NOT note AND can), 0)
           + 2.0 * coalesce(sum(w * log10(1 + greatest(0, likes))) FILTER (note AND can), 0)
           + 0.5 * coalesce(sum(w * log10(1 + greatest(0, likes))) FILTER (NOT note AND can), 0), 2) AS score,
         max(content_time_ms) AS latest_item_ms, max(quote) FILTER (best = 1 AND can) AS top_quote
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker, can ORDER BY readable DESC, aside, focused DESC, likes DESC, note DESC, source_id) AS best FROM (
    SELECT *, (1.0 / k) * CASE WHEN aside THEN 0.3 ELSE 1.0 END AS w, k <= 3 AND in_prose AS focused FROM (
      SELECT s.*, {substance('s.body')} >= 20 AS readable, substr(s.body, 1, 100) AS quote,
             count(*) OVER (PARTITION BY source_type, source_id, is_index) AS k FROM (
        SELECT m.ticker, m.source_type, m.source_id, m.content_time_ms, true AS note, n.liked_count AS likes, n.dup_group_id IS NULL AS can,
               b.body, coalesce(c.is_non_stock, false) AS is_index,
               {term_count('b.body', 'm.matched_alias')} <= 1 AND length(b.body) >= 300 AS aside,
               {has_term('b.prose', 'm.matched_alias')} AS in_prose
        FROM mentions m JOIN notes n ON n.note_id = m.source_id
        JOIN (SELECT n.note_id, {body} AS body, {prose} AS prose FROM notes n) b ON b.note_id = n.note_id
        LEFT JOIN classes c ON c.ticker = m.ticker WHERE m.source_type = 'note' AND m.content_time_ms >= {cut}
        UNION ALL
        SELECT m.ticker, m.source_type, m.source_id, m.content_time_ms, false, x.like_count, x.dup_group_id IS NULL,
               {squeeze('x.content')}, coalesce(c.is_non_stock, false), false, true
        FROM mentions m JOIN comments x ON x.comment_id = m.source_id LEFT JOIN classes c ON c.ticker = m.ticker
        WHERE m.source_type = 'comment' AND m.content_time_ms >= {cut}) s))) GROUP BY ticker"""


part("stats", "mentions notes comments classes", stats_sql(CUT))
part("fresh_stats", "mentions notes comments classes", stats_sql(FRESH_CUT))

# ---- evidence ----

_FULL = clean_tags(note_text("n.title", "n.note_desc"))
part("fan", "mentions", f"""SELECT source_type, source_id, count(DISTINCT ticker) AS fanout FROM mentions
  WHERE content_time_ms >= {CUT} GROUP BY 1, 2""")
part("note_items", "mentions notes", f"""
  SELECT *, {substance('text')} AS substance FROM (
    SELECT ticker, id, likes, ts, url, {excerpt('full_text', 'pos')} AS text, hits <= 1 AND length(full_text) >= 300 AS aside FROM (
      SELECT *, {term_pos('full_text', 'matched_alias')} AS pos, {term_count('full_text', 'matched_alias')} AS hits FROM (
        SELECT m.ticker, n.note_id AS id, n.liked_count AS likes, n.publish_time_ms AS ts, n.note_url AS url, m.matched_alias, {_FULL} AS full_text
        FROM mentions m JOIN notes n ON n.note_id = m.source_id
        WHERE m.source_type = 'note' AND m.content_time_ms >= {CUT} AND n.dup_group_id IS NULL))) WHERE {substance('text')} >= 15""")
part("picked", "mentions notes comments fan", f"""
  SELECT ticker, c.comment_id AS id, c.content, c.note_id, c.like_count AS likes, c.create_time_ms AS ts, c.parent_comment_id AS parent, NULL AS head
  FROM mentions m JOIN comments c ON c.comment_id = m.source_id
  WHERE m.source_type = 'comment' AND m.content_time_ms >= {CUT} AND c.dup_group_id IS NULL
  UNION ALL
  SELECT ticker, id, content, note_id, likes, ts, parent, head FROM (
    SELECT m.ticker, c.comment_id AS id, c.content, c.note_id, c.like_count AS likes, c.create_time_ms AS ts, c.parent_comment_id AS parent,
           CASE WHEN {substance(_FULL)} >= 15 THEN '主帖「' || substr({clean_tags('n.title')}, 1, 20) || '」下的评论' ELSE '主帖下的评论' END AS head,
           row_number() OVER (PARTITION BY m.ticker, c.note_id ORDER BY c.like_count DESC, c.comment_id) AS rn
    FROM mentions m JOIN notes n ON n.note_id = m.source_id JOIN comments c ON c.note_id = n.note_id
    JOIN fan f ON f.source_type = 'note' AND f.source_id = m.source_id AND f.fanout <= 2
    WHERE m.source_type = 'note' AND m.content_time_ms >= {CUT} AND c.create_time_ms >= {CUT} AND c.dup_group_id IS NULL
      AND NOT EXISTS (SELECT 1 FROM mentions d JOIN comments e ON e.comment_id = d.source_id AND e.dup_group_id IS NULL
                      WHERE d.source_type = 'comment' AND d.ticker = m.ticker AND d.source_id = c.comment_id)) WHERE rn <= 5""")
part("thread_rows", "picked comments", f"""
  SELECT *, {squeeze('content')} AS line FROM (
    SELECT * FROM picked UNION ALL
    SELECT w.ticker, c.comment_id, c.content, c.note_id, c.like_count, c.create_time_ms, c.parent_comment_id, NULL
    FROM (SELECT DISTINCT ticker, parent FROM picked WHERE parent IS NOT NULL) w JOIN comments c ON c.comment_id = w.parent
    WHERE NOT EXISTS (SELECT 1 FROM picked p WHERE p.ticker = w.ticker AND p.id = w.parent))""")
part("thread_items", "thread_rows", f"""
  SELECT *, max(likes) OVER (PARTITION BY ticker, unit) AS unit_likes FROM (
    SELECT ticker, id, substr(card, 1, 150) AS text, substr(CASE WHEN shown THEN '↳ ' || line ELSE card END, 1, 150) AS prompt_text,
           likes, ts, substance, (parent IS NOT NULL)::INT AS depth, coalesce(parent, id) AS unit FROM (
      SELECT *, CASE WHEN parent IS NOT NULL AND (shown OR coalesce(snippet, '') <> '') THEN '回复「' || snippet || '」: ' || line
                     WHEN parent IS NULL AND head IS NOT NULL THEN head || ': ' || line ELSE line END AS card FROM (
        SELECT r.*, {substance('r.line')} AS substance, substr(p.line, 1, 30) AS snippet,
               r.parent IS NOT NULL AND p.id IS NOT NULL AND p.parent IS NULL AND NOT contains(p.line, '@问一问') AND {substance('p.line')} >= 6 AS shown
        FROM thread_rows r LEFT JOIN thread_rows p ON p.ticker = r.ticker AND p.id = r.parent
        WHERE NOT contains(r.line, '@问一问') AND {substance('r.line')} >= 6)))""")
part("items", "note_items thread_items notes comments fan", f"""
  SELECT x.*, coalesce(z.n, 1) AS cluster_size, coalesce(f.fanout, 1) AS fanout FROM (
    SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY unit_likes DESC, unit, depth, ts, type, id) AS item_no FROM (
      SELECT ticker, 'note' AS type, id, text, text AS prompt_text, likes, ts, url, substance, aside, id AS unit, likes AS unit_likes, 0 AS depth FROM note_items
      UNION ALL
      SELECT ticker, 'comment', id, text, prompt_text, likes, ts, NULL, substance, false, unit, unit_likes, depth FROM thread_items)) x
  LEFT JOIN (SELECT 'note' AS type, coalesce(dup_group_id, note_id) AS id, count(*) AS n FROM notes WHERE publish_time_ms >= {CUT} GROUP BY 1, 2
             UNION ALL SELECT 'comment', coalesce(dup_group_id, comment_id), count(*) FROM comments WHERE create_time_ms >= {CUT} GROUP BY 1, 2) z
    ON z.type = x.type AND z.id = x.id
  LEFT JOIN fan f ON f.source_type = x.type AND f.source_id = x.id WHERE item_no <= 60""")
part("prints", "items", """
  SELECT ticker, sha256(string_agg(type || ':' || id, '|' ORDER BY type || ':' || id)) AS input_hash,
         sha256(string_agg(type || ':' || id, '|' ORDER BY item_no)) AS evidence_hash, count(*) AS item_count,
         count(*) FILTER (type = 'note') AS note_count FROM items GROUP BY ticker""")

# ---- tables derived from events, orders, conversations, parts ----

part("ev", "", "SELECT *, epoch_us(ts) // 1000 AS ms FROM events")
part("snaps", "ev", """
  SELECT upper(substr(event_type, 1, 3)) || (user_id % 6) AS ticker, ms // 86400000 * 86400000 AS snapped_at_ms,
         round(sum(value), 2) AS score, count(*) AS mentions, count(*) FILTER (value < 50) AS note_count,
         count(*) FILTER (value >= 50) AS comment_count FROM ev GROUP BY 1, 2""")
part("ana", "ev", """
  SELECT ticker, b AS run_id, b * 21600000 AS generated_at_ms, bull, bear, neu, n,
         CASE WHEN b % 7 = 0 THEN '{bad' ELSE '{"bullish":' || bull || ',"bearish":' || bear || ',"neutral":' || neu || '}' END AS sentiment_counts,
         '  net ' || (bull - bear) || ' ' AS summary, sha256(ticker || '|' || n) AS input_hash, 'm' || (b % 3) AS model,
         n * 1000 AS input_tokens, n * 77 AS output_tokens,
         CASE WHEN b % 5 = 0 THEN 'no_api_key' WHEN b % 11 = 0 THEN 'error' ELSE 'ok' END AS status
  FROM (SELECT 'U' || (user_id % 8) AS ticker, ms // 21600000 AS b, count(*) FILTER (event_type IN ('purchase','signup')) AS bull,
          count(*) FILTER (event_type = 'error') AS bear, count(*) FILTER (event_type = 'view') AS neu, count(*) AS n FROM ev GROUP BY 1, 2)""")
part("px", "", """
  SELECT 'U' || (CAST(substr(o_orderpriority, 1, 1) AS INT) - 1) AS ticker, CAST(o_orderdate AS DATE) + 8429 AS date,
         max(o_totalprice) AS close FROM orders GROUP BY 1, 2""")
part("ledger", "ev", """
  SELECT event_id AS id, ms AS started_at_ms, CASE WHEN event_type <> 'view' THEN ms + CAST(floor(value) AS BIGINT) * 1000 END AS finished_at_ms,
         error, CAST(floor(value) AS BIGINT) AS requests_est, user_id % 4 AS notes_fresh,
         CASE WHEN event_type = 'view' THEN 'running' WHEN error IS NOT NULL THEN 'failed' ELSE 'success' END AS status,
         CASE WHEN user_id % 13 = 0 THEN 'expired' WHEN user_id % 29 = 0 THEN 'unauthorized' ELSE 'unknown' END AS log_class
  FROM (SELECT *, CASE WHEN event_type = 'error' AND user_id % 10 = 0 THEN 'login_required'
                       WHEN event_type = 'click' AND user_id % 3 = 0 THEN 'stopped after 10 CAPTCHAs' END AS error FROM ev)""")
part("log", "", """
  SELECT conv_id AS run_id, turn AS lineno, CASE WHEN role = 'system' THEN 'ValueError: ' || body
    WHEN turn % 5 = 0 THEN '2024-01-01 00:00:0' || turn || ' x INFO - Current search keyword: k' || ((conv_id + turn) % 4)
    WHEN turn % 5 = 1 THEN 'Begin get note id comments ' || body
    WHEN turn % 5 = 2 THEN '2024-01-01 00:00:02 a ERROR (f.py:1) - ' || CASE WHEN conv_id % 3 = 0 THEN 'RetryError ' ELSE '' END || body
    WHEN conv_id % 2 = 0 THEN 'CAPTCHA appeared ' || body
    ELSE CASE WHEN conv_id % 5 = 0 THEN 'ConnectTimeout login expired ' ELSE '' END || body END AS line
  FROM (SELECT *, replace(text, chr(10), ' ') AS body FROM conversations)""")
part("log_runs", "", """
  SELECT DISTINCT conv_id AS run_id, conv_id % 3 AS exit_code, conv_id % 2 AS notes_fresh,
         CASE conv_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'running' ELSE 'failed' END AS status FROM conversations""")
part("pstocks", "", f"""
  SELECT 'P' || p_partkey AS ticker, p_name AS name, CASE WHEN p_type = 'PROMO' THEN '{K.INDEX_SECTOR}' ELSE p_type END AS sector,
         CASE p_size % 7 WHEN 0 THEN 'commodity' WHEN 1 THEN 'crypto' WHEN 2 THEN '' END AS asset_class,
         string_split(p_name, ' ') AS aliases, CASE WHEN p_size % 2 = 0 THEN [p_brand] ELSE []::VARCHAR[] END AS ambiguous,
         CASE WHEN p_size % 5 = 0 THEN p_brand || '=F' END AS quote_symbol FROM part""")
part("pover", "", """
  SELECT 'P' || (p_partkey + 500) AS ticker, 'overlay' AS name, 'overlay' AS sector,
         [lower(p_type), split_part(p_name, ' ', 1)] AS aliases, [p_brand, 'x'] AS ambiguous FROM part""")
part("ctracked", "", """
  SELECT 'P' || (c_custkey * 2) AS ticker, c_custkey AS added_at_ms,
         to_json([c_mktsegment, '', 'seg ' || c_nationkey])::VARCHAR AS custom_keywords FROM customer""")
part("sugg", "", """
  SELECT c_custkey AS id, lower(c_mktsegment) AS term, 'P' || (c_custkey % 700) AS guessed_ticker, c_name AS evidence_quote,
         c_custkey * 10 AS suggested_at_ms, CASE WHEN c_acctbal < 0 THEN 'rejected' ELSE 'pending' END AS status FROM customer""")
LAND_MS = f"({NOW_MS} - (doc_id * 7919 % 10080) * 60000)"
part("land_n", "", f"""
  SELECT doc_id AS line_no, doc_id % 31 = 0 AS bad, CASE WHEN doc_id % 31 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN '' ELSE CAST(doc_id // 2 * 2 AS VARCHAR) END AS note_id,
         split_part(text, chr(10), 1) AS title, text AS "desc", source AS source_keyword,
         CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN {LAND_MS} // 1000 * 1000 ELSE {LAND_MS} END AS ts,
         CASE doc_id % 4 WHEN 0 THEN (doc_id % 90) * 10000 + 5000 WHEN 1 THEN doc_id % 50 WHEN 2 THEN 1234 ELSE 0 END AS liked_count
  FROM documents""")
part("land_c", "", f"""
  SELECT conv_id * 1000 + turn AS line_no, conv_id || '-' || turn AS comment_id, CAST(conv_id AS VARCHAR) AS note_id, text AS content,
         CASE WHEN turn > 0 THEN conv_id || '-0' END AS parent_comment_id, turn * 3 AS like_count,
         CASE WHEN (conv_id + turn) % 37 = 0 THEN NULL ELSE {NOW_MS} - (conv_id * 7919 % 10080) * 60000 + turn * 1000 END AS ts
  FROM conversations""")


def sql(needs: list[str], body: str) -> str:
    """One statement: the needed parts in dependency order, then the body."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for d in PARTS[name][0].split():
            visit(d)
        ordered.append(name)

    for n in needs:
        visit(n)
    if not ordered:
        return body.strip()
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n][1]})" for n in ordered)
    head = "WITH RECURSIVE " if "RECURSIVE" in body else "WITH "
    body = body.strip()
    if body.upper().startswith("WITH "):
        body = body[5:].replace("RECURSIVE ", "", 1) if body.upper().startswith("WITH RECURSIVE") else body[5:]
        return head + ctes + ",\n" + body
    return head + ctes + "\n" + body
