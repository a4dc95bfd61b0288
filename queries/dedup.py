"""Duplicates: fingerprints, near pairs, clusters, exact copies. Word 3-grams with md5, so that
SQL can repeat them on this prose."""


from crowdgauge.operators import dedup as DD
from crowdgauge.plans.cycle import run_cycle

from .base import Registry
from .sqlparts import CUT, part, stats_sql

Q = Registry()

part("prints3", "notes0", """
  SELECT n.note_id, n.liked_count, n.publish_time_ms, CAST(coalesce(x.h, 0) AS BIGINT) AS simhash FROM notes0 n LEFT JOIN (
    SELECT note_id, sum(CASE WHEN v > 0 THEN CASE WHEN b = 63 THEN -9223372036854775808 ELSE (1::BIGINT << b)::HUGEINT END ELSE 0 END) AS h FROM (
      SELECT note_id, b, sum(c * (2 * ((h >> b) & 1)::BIGINT - 1)) AS v FROM (
        SELECT note_id, g, count(*) AS c, CAST('0x' || substr(md5(g), 1, 16) AS UBIGINT) AS h FROM (
          SELECT note_id, array_to_string(w[i:i + 2], ' ') AS g FROM (
            SELECT note_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM (
              SELECT note_id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(note_desc, '')), '[0-9a-z一-鿿]+') AS w FROM notes0) WHERE len(w) > 0)) GROUP BY 1, 2),
        range(64) r(b) GROUP BY 1, 2) GROUP BY 1) x ON x.note_id = n.note_id""")
part("near", "prints3", """
  SELECT a.simhash AS a, b.simhash AS b FROM (SELECT DISTINCT simhash FROM prints3 WHERE simhash <> 0) a JOIN (SELECT DISTINCT simhash FROM prints3 WHERE simhash <> 0) b
  ON a.simhash < b.simhash AND bit_count(xor(a.simhash, b.simhash)) <= 6""")
CLUSTERS = """WITH RECURSIVE e AS (SELECT a, b FROM near UNION SELECT b, a FROM near UNION SELECT DISTINCT simhash, simhash FROM prints3 WHERE simhash <> 0),
  reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
  roots AS (SELECT a AS simhash, min(b) AS root FROM reach GROUP BY 1),
  tops AS (SELECT root, max((liked_count, p.note_id)) AS top, count(*) AS members FROM prints3 p JOIN roots r ON r.simhash = p.simhash GROUP BY 1)"""
MARKED = CLUSTERS + """, marks AS (SELECT p.note_id, CASE WHEN t.members > 1 AND t.top[2] <> p.note_id THEN t.top[2] END AS dup_group_id
  FROM prints3 p LEFT JOIN roots r ON r.simhash = p.simhash LEFT JOIN tops t ON t.root = r.root)"""


@Q.add("f06_simhash_words", "prints3", "SELECT note_id, simhash FROM prints3")
def _(t):
    return t.fingerprinted.select("note_id", "simhash")


@Q.add("j17_near_pairs", "near", "SELECT a, b FROM near")
def _(t):
    return DD.near_pairs(t.fingerprinted)


@Q.add("g06_note_clusters", "near", MARKED + " SELECT note_id, dup_group_id FROM marks WHERE dup_group_id IS NOT NULL")
def _(t):
    return DD.mark_notes(t.fingerprinted, t.context, t.now).filter("dup_group_id IS NOT NULL").select("note_id", "dup_group_id")


@Q.add("g07_comment_copies", "comments", "SELECT comment_id, dup_group_id FROM comments")
def _(t):
    return t.comments.select("comment_id", "dup_group_id")




@Q.add("g07_document_copies", "notes", "SELECT note_id, dup_group_id FROM notes")
def _(t):
    return t.notes.select("note_id", "dup_group_id")


@Q.add("c03_dedup_counts", "near comments", MARKED + """ SELECT (SELECT count(*) FROM marks WHERE dup_group_id IS NOT NULL) AS note_dups,
  (SELECT count(*) FROM comments WHERE dup_group_id IS NOT NULL) AS comment_dups""")
def _(t):
    n, c = DD.recompute(t.fingerprinted, t.ingested_comments, t.context, t.now)
    return DD.dup_counts(n, c, t.context, t.now)


NEAR_NOTES = "n2 AS (SELECT n.* EXCLUDE (dup_group_id), m.dup_group_id FROM notes n JOIN marks m ON m.note_id = n.note_id)"


@Q.add("cycle_heat", "near notes comments mentions classes", MARKED + ", " + NEAR_NOTES + ", st AS ("
       + stats_sql(CUT).replace("JOIN notes n ON", "JOIN n2 n ON").replace("FROM notes n)", "FROM n2 n)")
       + ") SELECT ticker, mentions, note_count, comment_count, focused_mentions, score FROM st")
def _(t):
    c = run_cycle(t.fingerprinted, t.ingested_comments, t.dictionary, t.now, tracked=t.tracked, run_id=7)
    return c.stats.filter("window = 'context'").select("ticker", "mentions", "note_count", "comment_count", "focused_mentions", "score")
