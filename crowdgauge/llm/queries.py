"""Queries of this folder over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat
from . import filter_audit as audit
from . import license_scan as licenses
from . import lm_score
from . import ngram_join
from . import packing
from . import pieces
from . import quality
from . import suffix_dedup as suffixes
from . import toxicity as tox
from . import vector_codes
from . import warc
from .common import table
from .exact_dedup import exact_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLES["op1_exact_dedup"] = f"""
WITH d AS (SELECT doc_id, {ASCII_LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)"""


@query
def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"), across_lines=True)


def _license_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    at = " UNION ALL ".join(
        f"SELECT doc_id, i AS place, {quoted(label)} AS label FROM (SELECT doc_id, words, unnest(range(len(words))) AS i FROM w) WHERE "
        + " AND ".join(f"words[i + {k + 1}] = {quoted(x)}" for k, x in enumerate(phrase.split(" ")))
        for phrase, label in licenses.PHRASES.items())
    templates = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in licenses.TEMPLATES.items())
    return f"""
WITH d AS (SELECT doc_id, {ASCII_LOWER} AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '{licenses.WORD}') AS words FROM d),
places AS ({at}),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
                list_sort(list_distinct(list(label))) AS labels FROM places GROUP BY doc_id),
templates AS (SELECT label, list_distinct(regexp_extract_all({ASCII_LOWER.replace("text", "body")}, '{licenses.WORD}')) AS tokens
              FROM (VALUES {templates}) AS v(label, body)),
lines AS (SELECT doc_id, regexp_extract_all(unnest(string_split(t, chr(10))), '{licenses.WORD}') AS words FROM d),
near AS (SELECT doc_id, label, len(list_intersect(tokens, words)) / len(tokens) AS share FROM lines, templates
         WHERE len(list_intersect(tokens, words)) * 100 >= {licenses.THRESHOLD_PERCENT} * len(tokens)),
found AS (SELECT doc_id, list_distinct(list(label)) AS labels, max(share) AS share FROM near GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(base.labels, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)"""


ORACLES["op8_license_scans"] = _license_sql()


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_warc(table(spark, sf_dir, "pages"))
    return warc.resolved(warc.read_warc(spark, path))


ORACLES["op9_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f"""


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality_rules(docs, quality.fitted(docs, table(spark, sf_dir, "labels")))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tox.toxicity(docs, tox.trained(docs, table(spark, sf_dir, "labels")))


AWKWARD = "\\### Assistant: </turn> ok"  # a text that holds the template's own marks, behind a backslash


@query
def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role").withColumn("text", F.lit(AWKWARD))
    return chat.read_back(chat.formatted(rows.unionByName(more)))


ORACLES["op2_chat_formatting"] = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, i, r, '{AWKWARD}' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(i, r)),
e AS (SELECT *, length(regexp_replace(text, '([\\\\<#:])', 'xx', 'g')) AS text_chars,
             CASE role WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 WHEN 'system' THEN 12
                       ELSE 11 + length(regexp_replace(role, '([\\\\<#:])', 'xx', 'g')) END AS head_chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(head_chars + text_chars + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"))


@query
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), width=3, percent=90)


ORACLES["op6_ngram_jaccard_join"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                                 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(low.b, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN low ON low.a = w.doc_id"""


@query
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_score.lm_scores(table(spark, sf_dir, "documents"), least=1, order=3)
    # Logs are summed in another order each time; four digits, the rest cut off, are the same in all of them.
    return scores.withColumns({c: F.expr(f"cast(round({c} * 1e6) AS bigint) div 100 / 1e4") for c in ("log_score", "mean_log_score")})


ORACLES["op5_lm_scoring"] = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({ASCII_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT row, w[i - 2] AS u, w[i - 1] AS v, w[i] AS w, i FROM (SELECT row, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
c3 AS (SELECT u, v, w, count(*) AS c FROM p WHERE i > 2 GROUP BY ALL),
c2 AS (SELECT v, w, count(*) AS c FROM p WHERE i > 1 GROUP BY ALL),
c1 AS (SELECT w, count(*) AS c FROM p GROUP BY ALL),
n AS (SELECT count(*)::DOUBLE AS n FROM p),
t AS (SELECT row, CASE WHEN i = 1 THEN ln(a.c) - ln(n) WHEN i = 2 THEN ln(b.c) - ln(x.c) ELSE ln(c3.c) - ln(y.c) END AS s
      FROM p JOIN n ON true JOIN c1 a ON a.w = p.w LEFT JOIN c1 x ON x.w = p.v AND i = 2 LEFT JOIN c2 b ON b.v = p.v AND b.w = p.w AND i = 2
      LEFT JOIN c3 ON c3.u = p.u AND c3.v = p.v AND c3.w = p.w AND i > 2 LEFT JOIN c2 y ON y.v = p.u AND y.w = p.v AND i > 2),
s AS (SELECT row, count(*) AS n_words, sum(s) AS s FROM t GROUP BY row)
SELECT doc_id, coalesce(n_words, 0) AS n_words, (round(s * 1e6)::BIGINT // 100) / 1e4 AS log_score, (round(s / n_words * 1e6)::BIGINT // 100) / 1e4 AS mean_log_score
FROM d LEFT JOIN s USING (row)"""


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _audit_sql() -> str:
    letters = ", ".join(f"('{f}', {k})" for k, f in enumerate(audit.FILTERS))
    signs = audit.SIGNS.decode()
    return f"""
WITH f AS (SELECT * FROM (VALUES {letters}) AS v(f, k)),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
           WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, part, [len(w) < {audit.LEAST_WORDS}, 100 * len(list_distinct(w)) < {audit.LEAST_DISTINCT_PERCENT} * len(w),
             100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {audit.MOST_CAPITALS_PERCENT} * length(t),
             length(translate(t, '{signs}', '')) < length(t), doc_id > min(doc_id) OVER (PARTITION BY t)] AS fails FROM d),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
      FROM x LEFT JOIN labels USING (doc_id) GROUP BY ALL),
steps AS (SELECT filter_order, u.step, substr(filter_order, u.step, 1) AS letter, k FROM orders, (SELECT unnest(range(1, 6)) AS step) u
          JOIN f ON f.f = substr(filter_order, u.step, 1)),
goes AS (SELECT part, fails, n, good, toxic, o.filter_order, min(step) FILTER (fails[k + 1]) AS gone
         FROM m, orders o JOIN steps s ON s.filter_order = o.filter_order GROUP BY ALL),
r AS (SELECT part, s.filter_order, s.step, s.letter, sum(n) FILTER (gone IS NULL OR gone > s.step) AS kept, sum(n) FILTER (gone = s.step) AS removed,
             sum(n) FILTER (gone < s.step AND fails[k + 1]) AS redundant,
             sum(n) FILTER (fails[k + 1] AND len(list_filter(fails, lambda y: y)) = 1) AS unique_fails,
             sum(good) FILTER (gone = s.step) AS good_lost, sum(toxic) FILTER (gone = s.step) AS toxic_lost
      FROM goes JOIN steps s USING (filter_order) GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
       coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley
FROM r"""


ORACLES["op13_filter_audit"] = _audit_sql()


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def _codes_sql() -> str:
    parts, rounds = vector_codes.PARTS, vector_codes.ROUNDS
    off = "list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT row, p, min(off) AS off, arg_min(e, (off, e)) AS e
    FROM (SELECT x.row, x.p, b.e, {off} AS off FROM x JOIN b{r} b ON b.p = x.p) GROUP BY row, p)""")
        if r < rounds:
            steps.append(f"""b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN (
    SELECT p, e, list(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END ORDER BY i) AS v
    FROM (SELECT a.p, a.e, u.i, sum(x.v[u.i])::BIGINT AS s, count(*) AS n FROM a{r} a JOIN x ON x.row = a.row AND x.p = a.p,
          (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM x))) AS i) u GROUP BY ALL) GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)""")
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, v) AS row, vec_id, label, v FROM (
    SELECT vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)),
x AS MATERIALIZED (SELECT row, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS v FROM k, (SELECT unnest(range({parts})) AS p)),
b0 AS MATERIALIZED (SELECT p, row - 1 AS e, v FROM x WHERE row <= {vector_codes.ENTRIES}),
{", ".join(steps)},
c AS (SELECT row, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(off)::BIGINT AS error FROM a{rounds} GROUP BY row),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS sha FROM b{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, sha AS codebooks_sha256
FROM k JOIN c USING (row), h"""


ORACLES["op11_vector_codes"] = _codes_sql()


@query
def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.suffix_dedup(table(spark, sf_dir, "documents")).drop("kept_spans")


# Texts as hexadecimal digits: byte k stands at digits 2k + 1 and 2k + 2.
ORACLES["op12_suffix_array_dedup"] = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT row, unnest(range(len(h) // 2 - {suffixes.LENGTH - 1})) AS s, h FROM d WHERE len(h) >= {2 * suffixes.LENGTH}),
k AS (SELECT row, s, md5_number(substr(h, 2 * s + 1, {2 * suffixes.LENGTH})) AS g FROM w),
f AS (SELECT row, s FROM (SELECT row, s, count(*) OVER (PARTITION BY g) AS n FROM k) WHERE n > 1),
i AS (SELECT row, s, coalesce(s > lag(s) OVER (PARTITION BY row ORDER BY s) + {suffixes.LENGTH}, true) AS fresh FROM f),
r AS (SELECT row, run, min(s) AS a, max(s) + {suffixes.LENGTH} AS b FROM
      (SELECT row, s, sum(fresh::INT) OVER (PARTITION BY row ORDER BY s) AS run FROM i) GROUP BY row, run),
p AS (SELECT row, a, b, coalesce(lag(b) OVER (PARTITION BY row ORDER BY a), 0) AS since FROM r),
t AS (SELECT row, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last,
             string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept FROM p JOIN d USING (row) GROUP BY row)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (row)"""
