"""F-*, M-*: text and value functions over whole texts."""

from pyspark.sql import functions as F

from crowdgauge import constants as K
from crowdgauge.functions import python_text as P
from crowdgauge.functions import text as T
from crowdgauge.functions import values as V

from .base import Registry
from .sqlparts import (
    arr, clean_tags, excerpt, norm_hash, note_text, squeeze, strip_hashtags, substance,
    term_count, term_pos, has_term,
)

Q = Registry()
DOC = "SELECT doc_id, {} FROM documents"
TAGGED = "('#' || lang || '[话题]# ' || text || ' #x' || source || '[话题]#')"


def tagged():
    return F.concat(F.lit("#"), "lang", F.lit("[话题]# "), "text", F.lit(" #x"), "source", F.lit("[话题]#"))


@Q.add("f01_norm_text", "", "SELECT doc_id, md5(text) AS digest, length(text) AS n FROM documents")
def _(t):
    wide = F.translate("text", "abc,", "ａｂｃ，")
    return t.raw("documents").select("doc_id", F.md5(T.norm_text(wide)).alias("digest"), F.length(T.norm_text(wide)).cast("bigint").alias("n"))


@Q.add("f01_nfkc_exact", "", "SELECT doc_id, md5(text) AS digest FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", F.md5(P.nfkc(F.translate("text", "abc,", "ａｂｃ，"))).alias("digest"))


@Q.add("f02_note_text", "", DOC.format(f"md5({note_text('split_part(text, chr(10), 1)', 'text')}) AS same, md5({note_text('source', 'text')}) AS joined"))
def _(t):
    return t.raw("documents").select(
        "doc_id", F.md5(T.note_text(F.substring_index("text", "\n", 1), "text")).alias("same"),
        F.md5(T.note_text("source", "text")).alias("joined"))


@Q.add("f03_clean_tags", "", DOC.format(f"md5({clean_tags(TAGGED)}) AS digest"))
def _(t):
    return t.raw("documents").select("doc_id", F.md5(T.clean_tags(tagged())).alias("digest"))


@Q.add("f04_strip_hashtags", "", DOC.format(f"md5({strip_hashtags(TAGGED)}) AS digest"))
def _(t):
    return t.raw("documents").select("doc_id", F.md5(T.strip_hashtags(tagged())).alias("digest"))


@Q.add("f05_norm_for_hash", "", DOC.format(f"md5({norm_hash('text')}) AS digest"))
def _(t):
    return t.raw("documents").select("doc_id", F.md5(T.norm_for_hash("text")).alias("digest"))


@Q.add("f06_simhash_char_preset")
def _(t):
    return t.raw("documents").select("doc_id", P.simhash64(T.norm_for_hash("text")).alias("simhash"))


@Q.add("f06_simhash_char_md5", "", f"""
  SELECT d.doc_id, CAST(coalesce(sum(CASE WHEN v > 0 THEN CASE WHEN b = 63 THEN -9223372036854775808 ELSE (1::BIGINT << b)::HUGEINT END ELSE 0 END), 0) AS BIGINT) AS simhash
  FROM documents d LEFT JOIN (
    SELECT doc_id, b, sum(c * (2 * ((h >> b) & 1)::BIGINT - 1)) AS v FROM (
      SELECT doc_id, g, count(*) AS c, CAST('0x' || substr(md5(g), 1, 16) AS UBIGINT) AS h FROM (
        SELECT doc_id, substr(s, CAST(i AS INT), 2) AS g FROM (
          SELECT doc_id, s, unnest(range(1, greatest(length(s), 2))) AS i FROM (SELECT doc_id, {norm_hash('text')} AS s FROM documents) WHERE s <> '')) GROUP BY 1, 2),
      range(64) r(b) GROUP BY 1, 2) x USING (doc_id) GROUP BY d.doc_id""")
def _(t):
    return t.raw("documents").select("doc_id", P.simhash64(T.norm_for_hash("text"), "char", 2, "md5").alias("simhash"))


@Q.add("f07_substance", "", DOC.format(f"CAST({substance(TAGGED)} AS BIGINT) AS substance"))
def _(t):
    return t.raw("documents").select("doc_id", T.substance(tagged()).cast("bigint").alias("substance"))


@Q.add("f08_hamming", "", """
  SELECT a.l_orderkey AS k, a.l_linenumber AS n, CAST(bit_count(xor(a.l_orderkey * 7919 + a.l_partkey, a.l_suppkey * 104729)) AS BIGINT) AS distance
  FROM lineitem a""")
def _(t):
    a, b = F.col("l_orderkey") * 7919 + F.col("l_partkey"), F.col("l_suppkey") * 104729
    return t.raw("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), T.hamming64(a, b).cast("bigint").alias("distance"))


@Q.add("f09_sha256", "", DOC.format("sha256(text) AS digest"))
def _(t):
    return t.raw("documents").select("doc_id", T.sha256_hex("text").alias("digest"))


@Q.add("f10_mask_traps", "", DOC.format("md5(replace(replace(lower(text), 'thon the', '~~~~~~~~'), 'que', '~~~')) AS digest"))
def _(t):
    masked = T.mask_phrases(F.lower("text"), F.array(F.lit("thon the"), F.lit("que")))
    return t.raw("documents").select("doc_id", F.md5(F.replace(masked, F.lit("\x00"), F.lit("~"))).alias("digest"))


ALIASES = ["thon", "of the", "lé", "ment", "erin"]
EACH = f"(SELECT unnest({arr(ALIASES)}) AS alias)"


def each_alias(t):
    return t.raw("documents").select("doc_id", "text", F.explode(F.array(*[F.lit(a) for a in ALIASES])).alias("alias"))


@Q.add("f11_bounded_term", "", f"SELECT doc_id, alias, {has_term('lower(text)', 'alias')} AS found FROM documents, {EACH}")
def _(t):
    return each_alias(t).select("doc_id", "alias", T.has_term(F.lower("text"), "alias").alias("found"))


@Q.add("f12_alias_hits", "", f"SELECT doc_id, alias, CAST({term_pos('text', 'alias')} AS BIGINT) AS pos, CAST({term_count('text', 'alias')} AS BIGINT) AS hits FROM documents, {EACH}")
def _(t):
    return each_alias(t).select("doc_id", "alias", T.term_position("text", "alias").cast("bigint").alias("pos"), T.term_count("text", "alias").cast("bigint").alias("hits"))


@Q.add("f13_excerpt", "", f"SELECT doc_id, {excerpt('s', 'p')} AS part FROM (SELECT doc_id, {squeeze('text')} AS s, instr(text, 'er') - 1 AS p FROM documents)")
def _(t):
    return t.raw("documents").select("doc_id", T.squeeze("text").alias("s"), (F.instr("text", F.lit("er")) - 1).alias("p")).select("doc_id", T.excerpt("s", "p").alias("part"))


@Q.add("f18_parse_count", "", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN trunc((o_orderkey % 1000 + 0.5) * 10000) WHEN 1 THEN (o_orderkey % 97) * 100000000
    WHEN 2 THEN o_orderkey % 500 WHEN 3 THEN 1234 WHEN 4 THEN (o_orderkey % 70) * 1000 ELSE 0 END::BIGINT AS n FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    s = lambda m: (k % m).cast("string")
    text = (F.when(k % 6 == 0, F.concat(s(1000), F.lit(".5万"))).when(k % 6 == 1, F.concat(s(97), F.lit(" 亿")))
            .when(k % 6 == 2, F.concat(s(500), F.lit("+"))).when(k % 6 == 3, "1,234").when(k % 6 == 4, F.concat(s(70), F.lit("K"))).otherwise("likes"))
    return t.raw("orders").select("o_orderkey", V.parse_count(text).alias("n"))


@Q.add("f19_quote_symbol", "pstocks", "SELECT ticker, replace(replace(name, ' ', '.'), '.', '-') AS symbol FROM pstocks")
def _(t):
    return t.part_stocks.select("ticker", V.quote_symbol(F.replace("name", F.lit(" "), F.lit("."))).alias("symbol"))


@Q.add("m01_normalize_ts", "", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN o_orderkey * 1000 + 1000 WHEN 2 THEN 1700000000000 + o_orderkey
    WHEN 3 THEN NULL ELSE (o_orderkey + 7) * 1000 END::BIGINT AS ms FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    text = (F.when(k % 5 == 0, "soon").when(k % 5 == 1, (k + 1).cast("string")).when(k % 5 == 2, (k + 1700000000000).cast("string"))
            .when(k % 5 == 3, (-k).cast("string")).otherwise(F.concat((k + 7).cast("string"), F.lit(".9"))))
    return t.raw("orders").select("o_orderkey", V.normalize_ts(text).alias("ms"))


@Q.add("m02_like_weight", "", "SELECT event_id, round(log10(1 + greatest(0, user_id - 20)), 6) AS w FROM events")
def _(t):
    return t.raw("events").select("event_id", F.round(V.like_weight(F.col("user_id") - 20), 6).alias("w"))


@Q.add("m03_rounding", "", "SELECT event_id, round(value * 0.1234567891, 2) AS score, round(value * 0.1234567891, 1) AS share, round(value * 0.1234567891, 4) AS close, round(value * 0.1234567891, 6) AS cost, CAST(round_even(value * 0.1234567891, 0) AS BIGINT) AS pct FROM events")
def _(t):
    v = F.col("value") * 0.1234567891
    return t.raw("events").select("event_id", F.round(v, 2).alias("score"), F.round(v, 1).alias("share"), F.round(v, 4).alias("close"),
                                  F.round(v, 6).alias("cost"), F.bround(v, 0).cast("bigint").alias("pct"))


@Q.add("m04_utc_day", "ev", "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(CAST(ts AS DATE) + 7 AS VARCHAR) AS week_later FROM ev")
def _(t):
    d = V.utc_day("ms")
    return t.events.select("event_id", d.cast("string").alias("day"), F.date_add(d, 7).cast("string").alias("week_later"))


@Q.add("m05_date_plus_week", "", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 7 AS VARCHAR) AS due FROM orders")
def _(t):
    return t.raw("orders").select("o_orderkey", F.date_add(F.col("o_orderdate").cast("date"), 7).cast("string").alias("due"))


@Q.add("m06_json_decode", "ana", "SELECT ticker, run_id, CASE WHEN run_id % 7 <> 0 THEN CAST(bull - bear AS BIGINT) END AS net FROM ana")
def _(t):
    return t.analyses.select("ticker", "run_id", V.lean("sentiment_counts").alias("net"))


@Q.add("m07_json_encode", "ana", "SELECT ticker, run_id, CASE WHEN run_id % 7 <> 0 THEN sentiment_counts END AS j FROM ana")
def _(t):
    return t.analyses.select("ticker", "run_id", F.to_json(V.sentiment("sentiment_counts")).alias("j"))


@Q.add("m09_arrays", "", """SELECT doc_id, array_to_string(w[1:4], '|') AS first4, CAST(len(list_distinct(w)) AS BIGINT) AS kinds, array_to_string(list_sort(list_distinct(w))[1:5], '|') AS low5
    FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)""")
def _(t):
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return t.raw("documents").select("doc_id", w.alias("w")).select(
        "doc_id", F.array_join(F.slice("w", 1, 4), "|").alias("first4"), F.size(F.array_distinct("w")).cast("bigint").alias("kinds"),
        F.array_join(F.slice(F.array_sort(F.array_distinct("w")), 1, 5), "|").alias("low5"))


@Q.add("p01_freshness", "notes0", "SELECT note_id, publish_time_ms FROM notes0 WHERE publish_time_ms >= {}".format(1704153600000 + 28 * K.DAY_MS - K.DAY_MS))
def _(t):
    return t.ingested_notes.filter(F.col("publish_time_ms") >= t.now - t.fresh).select("note_id", "publish_time_ms")


@Q.add("p02_canonical", "notes comments", "SELECT note_id AS id FROM notes WHERE dup_group_id IS NULL UNION ALL SELECT comment_id FROM comments WHERE dup_group_id IS NULL")
def _(t):
    return t.notes.filter("dup_group_id IS NULL").select(F.col("note_id").alias("id")).unionByName(
        t.comments.filter("dup_group_id IS NULL").select(F.col("comment_id").alias("id")))


@Q.add("p05_aside", "", f"SELECT doc_id, {term_count('text', arr(['the'])[1:6])} <= 1 AND length(text) >= 300 AS aside FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", T.is_aside("text", T.term_count("text", F.lit("the"))).alias("aside"))


@Q.add("p06_bot_prompt", "", "SELECT conv_id, turn, contains(text || '@' || role, '@system') OR contains(text || '@' || role, '@assistant') AS bot FROM conversations")
def _(t):
    return t.raw("conversations").select("conv_id", "turn", T.is_bot_prompt(F.concat("text", F.lit("@"), "role"), ("system", "assistant")).alias("bot"))


@Q.add("p07_substance_floors", "", f"""SELECT doc_id, s >= 15 AS note_ok, s >= 6 AS comment_ok, s >= 20 AS quote_ok FROM (
    SELECT doc_id, {substance('text')} AS s FROM documents)""")
def _(t):
    s = T.substance("text")
    return t.raw("documents").select("doc_id", (s >= K.MIN_NOTE_SUBSTANCE).alias("note_ok"), (s >= K.MIN_COMMENT_SUBSTANCE).alias("comment_ok"), (s >= K.QUOTE_MIN_SUBSTANCE).alias("quote_ok"))


@Q.add("p08_search_predicate", "", "SELECT doc_id FROM documents WHERE lower(text) LIKE '%thon%er_n%'")
def _(t):
    return t.raw("documents").filter(T.search_match("text", "Thon%er_n")).select("doc_id")


@Q.add("p09_valid_ticker", "", "SELECT c_custkey, regexp_full_match(substr(c_mktsegment, 1, CAST(c_custkey % 8 AS INT)), '[A-Z]{1,5}') AS ok FROM customer")
def _(t):
    return t.raw("customer").select("c_custkey", V.valid_ticker(F.substring(F.col("c_mktsegment"), F.lit(1), (F.col("c_custkey") % 8).cast("int"))).alias("ok"))


@Q.add("p11_divergence", "", "SELECT event_id, (user_id % 7 - 3 >= 2 AND value / 40 - 6 <= -2) OR (user_id % 7 - 3 <= -2 AND value / 40 - 6 >= 2) AS d FROM events")
def _(t):
    return t.raw("events").select("event_id", V.divergence(F.col("user_id") % 7 - 3, F.col("value") / 40 - 6).alias("d"))


@Q.add("p12_ages", "ev", "SELECT event_id, greatest(0, (1706000000000 - ms) // 3600000) AS age_h FROM ev")
def _(t):
    return t.events.select("event_id", V.age_hours(1706000000000, "ms").alias("age_h"))


@Q.add("p13_sentiment_sign", "ana", "SELECT ticker, run_id, CASE WHEN run_id % 7 = 0 THEN 'neut' WHEN bull > bear THEN 'bull' WHEN bull < bear THEN 'bear' ELSE 'neut' END AS sign FROM ana")
def _(t):
    s = V.sentiment("sentiment_counts")
    return t.analyses.select("ticker", "run_id", V.sentiment_sign(s["bullish"], s["bearish"]).alias("sign"))


@Q.add("p16_split_list", "", """SELECT p_partkey, array_to_string(list_filter([w, b], lambda x: x IS NOT NULL AND x <> ''), '|') AS items FROM (
    SELECT p_partkey, trim(p_name) AS w, CASE WHEN p_brand <> trim(p_name) THEN p_brand END AS b FROM part)""")
def _(t):
    raw = F.concat_ws(",", F.concat(F.lit(" "), "p_name"), F.lit(" "), "p_brand", "p_name", F.lit(""))
    return t.raw("part").select("p_partkey", F.array_join(V.split_list(raw), "|").alias("items"))
