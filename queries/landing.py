"""Landing: parsing, quarantine, ingest, accounting, attribution."""

from pyspark.sql import functions as F

from crowdgauge import schemas as S
from crowdgauge.operators import keywords as KW
from crowdgauge.sources import landing as LD

from .base import Registry
from .sqlparts import CUT

Q = Registry()
BAD_N = "(bad OR note_id IS NULL OR note_id = '' OR ts IS NULL)"


def notes_in(t):
    return LD.parse_lines(t.landing_note_lines, S.LANDING_NOTE)


def comments_in(t):
    return LD.parse_lines(t.landing_comment_lines, S.LANDING_COMMENT)


@Q.add("a01_parse_lines", "land_n", "SELECT line_no, bad, note_id, md5(CASE WHEN NOT bad THEN \"desc\" END) AS digest FROM land_n")
def _(t):
    return notes_in(t).select("line_no", F.col("_bad").isNotNull().alias("bad"), F.when(F.col("_bad").isNull(), F.col("note_id")).alias("note_id"),
                              F.when(F.col("_bad").isNull(), F.md5("desc")).alias("digest"))


@Q.add("a02_quarantine", "land_n", f"SELECT line_no, {BAD_N} AS malformed FROM land_n")
def _(t):
    good, bad = LD.quarantine(notes_in(t), ["note_id"], "time")
    return good.select("line_no", F.lit(False).alias("malformed")).unionByName(bad.select("line_no", F.lit(True).alias("malformed")))


FOLD = f"""SELECT note_id, arg_max(title, line_no) AS title, arg_max(liked_count, line_no) AS liked_count, arg_min(ts, line_no) AS publish_time_ms FROM land_n WHERE NOT {BAD_N} AND ts >= {CUT} GROUP BY 1"""


@Q.add("a03_note_ingest", "land_n notes0", f"""WITH f AS ({FOLD}), o AS (SELECT * FROM notes0 WHERE liked_count >= 500)
  SELECT coalesce(o.note_id, f.note_id) AS note_id, coalesce(f.title, o.title) AS title, coalesce(f.liked_count, o.liked_count) AS liked_count, coalesce(o.publish_time_ms, f.publish_time_ms) AS publish_time_ms,
    CASE WHEN o.note_id IS NULL THEN 9 ELSE 1 END AS first_seen_run_id, CASE WHEN f.note_id IS NULL THEN 1 ELSE 9 END AS last_seen_run_id FROM o FULL JOIN f ON f.note_id = o.note_id""")
def _(t):
    old = t.ingested_notes.filter("liked_count >= 500").select(
        "note_id", "title", "note_desc", "liked_count", "publish_time_ms", "source_keyword", F.lit(1).cast("bigint").alias("first_seen_run_id"),
        F.lit(1).cast("bigint").alias("last_seen_run_id"), F.lit(0).cast("bigint").alias("fetched_at_ms"))
    return LD.ingest_notes(old, notes_in(t), 9, t.context, t.now).select("note_id", "title", "liked_count", "publish_time_ms", "first_seen_run_id", "last_seen_run_id")


@Q.add("a04_comment_ingest", "land_c notes0", f"""SELECT comment_id, note_id, like_count, ts AS create_time_ms,
  CASE WHEN length(regexp_replace(lower(content), '[^0-9a-z一-鿿]+', '', 'g')) >= 8 THEN regexp_replace(lower(content), '[^0-9a-z一-鿿]+', '', 'g') END AS content_norm_hash
  FROM land_c c WHERE ts >= {CUT} AND EXISTS (SELECT 1 FROM notes0 n WHERE n.note_id = c.note_id AND n.liked_count >= 200)""")
def _(t):
    known = t.ingested_notes.filter("liked_count >= 200")
    return LD.comment_rows(comments_in(t), known, 9, t.context, t.now).select("comment_id", "note_id", "like_count", "create_time_ms", "content_norm_hash")


@Q.add("a07_accounting", "land_n land_c notes0", f"""SELECT (SELECT count(*) FROM land_n WHERE NOT {BAD_N}) AS notes_fetched, (SELECT count(*) FROM land_n WHERE NOT {BAD_N} AND ts >= {CUT}) AS notes_fresh,
  (SELECT count(*) FROM land_c WHERE ts IS NOT NULL) AS comments_seen, (SELECT count(*) FROM land_c c WHERE ts >= {CUT} AND note_id IN (SELECT note_id FROM notes0)) AS comments_fresh,
  (SELECT count(*) FROM land_n WHERE {BAD_N}) + (SELECT count(*) FROM land_c WHERE ts IS NULL) AS malformed""")
def _(t):
    return LD.accounting(notes_in(t), comments_in(t), t.ingested_notes, t.context, t.now)


@Q.add("j22_keyword_attribution", "land_n land_c", """
  WITH n AS (SELECT *, source_keyword AS keyword FROM land_n WHERE NOT bad), o AS (SELECT note_id, arg_max(keyword, line_no) AS keyword FROM n WHERE note_id <> '' GROUP BY 1)
  SELECT k.keyword, k.notes, coalesce(c.comments, 0) AS comments FROM (SELECT keyword, count(*) AS notes FROM n GROUP BY 1) k
  LEFT JOIN (SELECT o.keyword, count(*) AS comments FROM land_c l JOIN o ON o.note_id = l.note_id GROUP BY 1) c ON c.keyword = k.keyword""")
def _(t):
    return KW.attribution(notes_in(t).filter("_bad IS NULL"), comments_in(t))
