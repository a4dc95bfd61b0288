"""Evidence: the ranked, threaded items behind each entity, for all entities at once.

Every per-entity list is cut to its cap by a row number, which Spark applies on the map side
before the shuffle; lists are collected only after that cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..functions import values as V
from ..session import checkpointed
from . import heat
from .dedup import cluster_sizes
from .facts import with_facts

ITEM_COLUMNS = ["ticker", "type", "id", "text", "prompt_text", "likes", "ts", "url", "substance",
                "aside", "cluster_size", "fanout", "unit", "unit_likes", "depth"]

# fixed values: wording of rendered lines
AGE_WORD = "小时前"
LIKES_WORD = "赞"
SIMILAR = "相似"
ROUNDUP = ("盘点·提及", "股")
ASIDE_MARK = "顺带提及"
REPLY_OPEN, REPLY_CLOSE = "回复「", "」: "
REPLY_ARROW = "↳ "


def note_items(mentions: DataFrame, notes: DataFrame, comments: DataFrame, cutoff_ms: int) -> DataFrame:
    """Canonical notes with readable prose, as excerpts around the first mention, which the mentions' facts hold."""
    window = mentions.filter((F.col("content_time_ms") >= cutoff_ms) & (F.col("source_type") == "note"))
    told = with_facts(window, notes, comments).select(
        F.col("source_id").alias("id"), "ticker", F.col("facts.excerpt").alias("text"), F.col("facts.aside").alias("aside"),
        T.substance("facts.excerpt").alias("substance")).filter(F.col("substance") >= K.MIN_NOTE_SUBSTANCE)
    n = notes.filter(F.col("dup_group_id").isNull()).select(
        F.col("note_id").alias("id"), F.coalesce("liked_count", F.lit(0)).alias("likes"),
        F.col("publish_time_ms").alias("ts"), F.col("note_url").alias("url"))
    return told.join(n, "id").select("ticker", "id", "likes", "ts", "url", "text", "aside", "substance")


def thread_heads(mentions: DataFrame, notes: DataFrame, comments: DataFrame, cutoff_ms: int) -> DataFrame:
    """(ticker, note_id, head) for notes focused enough that a comment below reacts to the entity."""
    window = mentions.filter(F.col("content_time_ms") >= cutoff_ms)
    fan = heat.source_fanout(window, cutoff_ms).filter(
        (F.col("source_type") == "note") & (F.col("fanout") <= K.THREAD_FANOUT_MAX))
    focused = with_facts(window.filter("source_type = 'note'"), notes, comments).join(fan.select("source_id"), "source_id", "left_semi").select(
        "ticker", F.col("source_id").alias("note_id"), F.col("facts.head").alias("head"))
    return focused.join(notes.select("note_id"), "note_id", "left_semi")


def _comment_fields() -> list[Column]:
    return [F.col("comment_id").alias("id"), F.col("note_id"),
            F.coalesce("like_count", F.lit(0)).alias("likes"), F.col("create_time_ms").alias("ts"),
            F.when(F.col("parent_comment_id") != "", F.col("parent_comment_id")).alias("parent")]


def picked_comments(mentions: DataFrame, notes: DataFrame, comments: DataFrame,
                    cutoff_ms: int, per_note: int = K.THREAD_PER_NOTE) -> DataFrame:
    """Direct mentions, and the ``per_note`` most liked comments under focused notes; without their texts."""
    canonical = comments.filter(F.col("dup_group_id").isNull())
    direct = mentions.filter(
        (F.col("content_time_ms") >= cutoff_ms) & (F.col("source_type") == "comment")
    ).select("ticker", F.col("source_id").alias("id")).join(
        canonical.select(*_comment_fields()), "id").withColumn("head", F.lit(None).cast("string"))
    heads = thread_heads(mentions, notes, comments, cutoff_ms)
    below = heads.join(
        canonical.filter(F.col("create_time_ms") >= cutoff_ms).select(*_comment_fields()), "note_id"
    ).join(direct.select("ticker", "id"), ["ticker", "id"], "left_anti")
    order = Window.partitionBy("ticker", "note_id").orderBy(F.desc("likes"), "id")
    pulled = below.withColumn("_rn", F.row_number().over(order)).filter(
        F.col("_rn") <= per_note).drop("_rn")
    return direct.unionByName(pulled.select(*direct.columns))


def with_parents(picked: DataFrame, comments: DataFrame) -> DataFrame:
    """Adds the missing parents of picked replies, one level up, whatever their age or cluster."""
    wanted = picked.filter(F.col("parent").isNotNull()).select(
        "ticker", F.col("parent").alias("id")).distinct()
    missing = wanted.join(picked.select("ticker", "id"), ["ticker", "id"], "left_anti")
    context = missing.join(comments.select(*_comment_fields()), "id").withColumn(
        "head", F.lit(None).cast("string"))
    return picked.unionByName(context.select(*picked.columns))


def lines_of(comments: DataFrame) -> DataFrame:
    """(id, line, substance, kept): of each comment as much as a card shows, and what the whole of it is worth."""
    rows = comments.select(F.col("comment_id").alias("id"), T.squeeze("content").alias("_line"))
    return rows.select("id", F.substring("_line", 1, K.COMMENT_TRUNC).alias("line"), T.substance("_line").alias("substance"),
                       T.is_bot_prompt("_line").alias("_bot")).select(
        "id", "line", "substance", (~F.col("_bot") & (F.col("substance") >= K.MIN_COMMENT_SUBSTANCE)).alias("kept"))


def thread_items(picked: DataFrame, comments: DataFrame) -> DataFrame:
    """Picked comments as conversation lines: text for a card, text for a prompt, thread, depth. Lines are cut where comments are
    scanned, so no longer text moves."""
    rows = checkpointed(with_parents(picked, comments).join(lines_of(comments), "id"))
    parent = rows.select(
        "ticker", F.col("id").alias("parent"),
        F.substring("line", 1, K.PARENT_SNIPPET).alias("snippet"),
        (F.col("kept") & F.col("parent").isNull()).alias("parent_shown"))
    joined = rows.filter("kept").join(parent, ["ticker", "parent"], "left")
    is_reply = F.col("parent").isNotNull()
    shown = is_reply & F.coalesce("parent_shown", F.lit(False))
    quoting = F.concat(F.lit(REPLY_OPEN), "snippet", F.lit(REPLY_CLOSE), "line")
    headed = F.concat(F.col("head"), F.lit(": "), "line")
    card = (
        F.when(is_reply & (shown | (F.coalesce("snippet", F.lit("")) != "")), quoting)
        .when(~is_reply & F.col("head").isNotNull(), headed)
        .otherwise(F.col("line"))
    )
    prompt = F.when(shown, F.concat(F.lit(REPLY_ARROW), "line")).otherwise(card)
    built = joined.select(
        "ticker", "id", F.substring(card, 1, K.COMMENT_TRUNC).alias("text"),
        F.substring(prompt, 1, K.COMMENT_TRUNC).alias("prompt_text"), "likes", "ts", "substance",
        is_reply.cast("int").alias("depth"), F.coalesce("parent", "id").alias("unit"))
    # A grouped maximum joined back, not a window: one thread may hold a third of all comments.
    best = built.groupBy("ticker", "unit").agg(F.max("likes").alias("unit_likes"))
    return built.join(best, ["ticker", "unit"])


def gather(mentions: DataFrame, notes: DataFrame, comments: DataFrame, window_ms: int, now_ms: int,
           cap: int = K.MAX_ITEMS, per_note: int = K.THREAD_PER_NOTE) -> DataFrame:
    """Evidence items of every entity with their number ``item_no``."""
    cutoff = now_ms - window_ms
    sizes = cluster_sizes(notes, "note_id", "publish_time_ms", window_ms, now_ms).select(
        F.lit("note").alias("type"), F.col("note_id").alias("id"), "cluster_size"
    ).unionByName(cluster_sizes(comments, "comment_id", "create_time_ms", window_ms, now_ms).select(
        F.lit("comment").alias("type"), F.col("comment_id").alias("id"), "cluster_size"))
    fan = heat.source_fanout(mentions, cutoff).select(
        F.col("source_type").alias("type"), F.col("source_id").alias("id"), "fanout")
    # What notes are worth is told for the items that survive the cap only; the test for readable prose has been passed.
    n = note_items(mentions, notes, comments, cutoff).withColumns({
        "substance": F.lit(None).cast("int"), "type": F.lit("note"), "prompt_text": F.col("text"), "unit": F.col("id"),
        "unit_likes": F.col("likes"), "depth": F.lit(0)})
    # The picked comments are read by parents, threads and lines: written once, not planned once for each.
    picked = checkpointed(picked_comments(mentions, notes, comments, cutoff, per_note))
    c = thread_items(picked, comments).withColumns({
        "type": F.lit("comment"), "aside": F.lit(False), "url": F.lit(None).cast("string")})
    order = Window.partitionBy("ticker").orderBy(
        F.desc("unit_likes"), "unit", "depth", "ts", "type", "id")
    # The cap comes first: sizes and fan-out are looked up for the surviving items only.
    top = n.unionByName(c).withColumn("item_no", F.row_number().over(order)).filter(
        F.col("item_no") <= cap).withColumn("substance", F.coalesce("substance", T.substance("text")))
    return top.join(sizes, ["type", "id"], "left").join(fan, ["type", "id"], "left").fillna(
        {"cluster_size": 1, "fanout": 1}).select("item_no", *ITEM_COLUMNS)


def ordered_list(value: Column, order: Column) -> Column:
    """Aggregate: values as an array in the given order."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.transform(pairs, lambda x: x["v"])


def fingerprints(items: DataFrame) -> DataFrame:
    """Per entity: which items (sorted) and which items in which order."""
    ref = F.concat_ws(":", "type", "id")
    return items.groupBy("ticker").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(ref)), "|"), 256).alias("input_hash"),
        F.sha2(F.array_join(ordered_list(ref, F.col("item_no")), "|"), 256).alias("evidence_hash"),
        F.count(F.lit(1)).alias("item_count"),
        F.count_if(F.col("type") == "note").alias("note_count"),
    )


def marks() -> Column:
    dup = F.when(F.col("cluster_size") > 1, F.concat(
        F.lit(" [×"), F.col("cluster_size").cast("string"), F.lit(SIMILAR + "]"))).otherwise("")
    roundup = F.when(F.col("fanout") >= K.FANOUT_ROUNDUP, F.concat(
        F.lit(" [" + ROUNDUP[0]), F.col("fanout").cast("string"), F.lit(ROUNDUP[1] + "]"))).otherwise("")
    aside = F.when(F.col("aside"), F.lit(f" [{ASIDE_MARK}]")).otherwise("")
    return F.concat(dup, roundup, aside)


def body_text() -> Column:
    return F.coalesce(F.when(F.col("prompt_text") != "", F.col("prompt_text")), F.col("text"))


def _stamp(now_ms: int) -> Column:
    return F.concat(
        F.lit("["), F.col("type"), F.lit("] ["), V.age_hours(now_ms, "ts").cast("string"),
        F.lit(AGE_WORD + "] [" + LIKES_WORD + ":"), F.col("likes").cast("string"), F.lit("]"))


def rendered_lines(items: DataFrame, now_ms: int) -> DataFrame:
    line = F.concat(F.lit("["), F.col("item_no").cast("string"), F.lit("] "), _stamp(now_ms),
                    marks(), F.lit(" "), body_text())
    return items.withColumn("line", line)


def render(items: DataFrame, now_ms: int, summaries: DataFrame | None = None) -> DataFrame:
    """Per entity: the numbered evidence text, which markers need a legend, and the previous
    summary when it is recent enough."""
    out = rendered_lines(items, now_ms).groupBy("ticker").agg(
        F.array_join(ordered_list(F.col("line"), F.col("item_no")), "\n").alias("evidence"),
        F.bool_or(F.col("cluster_size") > 1).alias("legend_similar"),
        F.bool_or(F.col("fanout") >= K.FANOUT_ROUNDUP).alias("legend_roundup"),
        F.bool_or("aside").alias("legend_aside"),
        F.bool_or(F.contains(body_text(), F.lit("…"))).alias("legend_excerpt"),
        F.bool_or(F.startswith(F.coalesce("prompt_text", F.lit("")), F.lit("↳"))).alias("legend_reply"),
    )
    if summaries is None:
        return out
    return out.join(previous_summaries(summaries, now_ms), "ticker", "left")


def previous_summaries(analyses: DataFrame, now_ms: int) -> DataFrame:
    """Latest ok summary not older than 48 hours, cut to 300 characters."""
    ok = analyses.filter(
        (F.col("status") == "ok") & F.col("summary").isNotNull()
        & (F.col("generated_at_ms") >= now_ms - K.PREV_SUMMARY_MAX_AGE_MS))
    return ok.groupBy("ticker").agg(F.substring(F.trim(F.max_by(
        "summary", F.struct("generated_at_ms", "summary"))), 1, K.PREV_SUMMARY_TRUNC).alias("prev_summary"))


def shared_numbers(items: DataFrame, groups: DataFrame) -> DataFrame:
    """Items of grouped entities with ``evidence_no``: the same evidence gets one number per
    group, in order of first appearance. ``groups`` has (group_id, group_pos, ticker)."""
    rows = items.join(groups, "ticker").withColumn("body", body_text())
    first = rows.groupBy("group_id", "type", "id", "body").agg(
        F.min(F.struct("group_pos", "item_no")).alias("first"))
    number = F.row_number().over(Window.partitionBy("group_id").orderBy("first"))
    return rows.join(first.withColumn("evidence_no", number).drop("first"),
                     ["group_id", "type", "id", "body"])


def render_shared(items: DataFrame, groups: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(evidence per group, references per entity) for several entities rated together."""
    rows = shared_numbers(items, groups)
    line = F.concat(F.lit("[E"), F.col("evidence_no").cast("string"), F.lit("] "), _stamp(now_ms),
                    F.lit(" "), "body")
    lines = rows.groupBy("group_id", "evidence_no").agg(F.min_by(line, F.struct("group_pos", "item_no")).alias("line"))
    evidence = lines.groupBy("group_id").agg(
        F.array_join(ordered_list(F.col("line"), F.col("evidence_no")), "\n").alias("evidence"))
    ref = F.concat(F.lit("["), F.col("item_no").cast("string"), F.lit("]=E"),
                   F.col("evidence_no").cast("string"), marks())
    refs = rows.groupBy("group_id", "group_pos", "ticker").agg(
        F.array_join(ordered_list(ref, F.col("item_no")), " ").alias("refs"))
    return evidence, refs


def overlap(items: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(left, right, weight): characters of roundup evidence two entities share. Each side has at
    most the evidence cap of rows per entity. Texts meet by their digest.

    With ``groups`` (group_id, ticker) only entities of one group meet, and group_id comes along: the work then follows the
    sizes of the groups, not how many entities of the dictionary a roundup names."""
    rows = items.filter(F.col("fanout") >= K.FANOUT_ROUNDUP).select(
        "ticker", "type", "id", F.md5(body_text()).alias("digest"), F.length(body_text()).alias("chars"))
    within = []
    if groups is not None:
        within = ["group_id"]
        rows = rows.join(groups.select("group_id", "ticker").distinct(), "ticker")
    a, b = rows.withColumnRenamed("ticker", "left"), rows.drop("chars").withColumnRenamed("ticker", "right")
    return a.join(b, [*within, "type", "id", "digest"]).filter(F.col("left") < F.col("right")).groupBy(
        *within, "left", "right").agg(F.sum("chars").alias("weight"))


def pick_quotes(items: DataFrame, k: int = K.MAX_QUOTES) -> DataFrame:
    """Up to k quotes per entity: not aside, low fan-out, liked; readable ones if there are any."""
    strong = F.col("substance") >= K.QUOTE_MIN_SUBSTANCE
    order = Window.partitionBy("ticker").orderBy(
        (~strong).cast("int"), F.col("aside").cast("int"), "fanout", F.desc("likes"), "item_no")
    rows = items.withColumn("quote_no", F.row_number().over(order)).filter(F.col("quote_no") <= k)
    best = rows.groupBy("ticker").agg(F.bool_or(strong).alias("_any"))
    return rows.join(best, "ticker").filter(strong | ~F.col("_any")).select("ticker", "quote_no", "text")


def fallback_quotes(items: DataFrame, k: int = K.MAX_QUOTES) -> DataFrame:
    """The first k comments of each entity, or its first k items when it has no comment."""
    comment = F.col("type") == "comment"
    order = Window.partitionBy("ticker").orderBy((~comment).cast("int"), "item_no")
    rows = items.withColumn("quote_no", F.row_number().over(order)).filter(F.col("quote_no") <= k)
    best = rows.groupBy("ticker").agg(F.bool_or(comment).alias("_any"))
    return rows.join(best, "ticker").filter(comment | ~F.col("_any")).select("ticker", "quote_no", "text")


def export(items: DataFrame, now_ms: int) -> DataFrame:
    """Numbered items as shown to a rater."""
    return items.select(
        "ticker", F.col("item_no").alias("n"), "type", "likes",
        V.age_hours(now_ms, "ts").alias("age_hours"), "aside", "fanout", body_text().alias("text"))
