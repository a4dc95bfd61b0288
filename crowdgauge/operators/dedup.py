"""Duplicate clusters: fingerprints within a small Hamming distance for notes, equal normalised
text for comments.

Copies are collapsed before anything is compared, so a third of the corpus being one post costs
one row. Distinct fingerprints that are equal outside a few bits are within the radius whatever
those bits hold: each is tied to the least of its group, and a dense ball contracts to one label
by a linear number of links. Only fingerprints of different labels are compared then, and only when
they agree on a whole bit block: of ``radius + 1`` blocks one is intact in any pair within the
radius. Key groups that are still costly are keyed again by a block of their other bits, by the
same argument, so nothing is lost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import python_text as P
from ..functions import text as T
from ..session import checkpointed


def fingerprinted(notes: DataFrame, unit: str = "char", size: int = 2,
                  digest: str = "blake2b") -> DataFrame:
    """Adds ``simhash`` of title and body. The defaults are the preset for short CJK posts."""
    body = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("note_desc", F.lit("")))
    text = T.norm_for_hash(body) if unit == "char" else F.lower(T.norm_text(body))
    return notes.withColumn("simhash", P.simhash64(text, unit, size, digest))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _split(bits: list[int], blocks: int) -> list[int]:
    """Masks of runs of about equal length that cover the given bit positions."""
    edges = [round(i * len(bits) / blocks) for i in range(blocks + 1)]
    return [sum(1 << x for x in bits[i:j]) for i, j in zip(edges, edges[1:], strict=False) if j > i]


def _finer(mask: int, radius: int) -> list[int]:
    """The mask with each block of its other bits: a pair that agrees on the mask agrees on one of these, too."""
    return [mask | m for m in _split([i for i in range(64) if not mask >> i & 1], radius + 1)] or [mask]


def _distinct(hashes: DataFrame, column: str) -> DataFrame:
    return hashes.select(F.col(column).alias("h")).filter(F.col("h").isNotNull() & (F.col("h") != 0)).distinct()


def _pairs(rows: DataFrame, radius: int) -> DataFrame:
    """Close pairs of different labels: those outside a group's main label meet the whole group, the others only them."""
    a, b = rows.filter("stray").alias("a"), rows.alias("b")
    same = (F.col("a.mask") == F.col("b.mask")) & (F.col("a.key") == F.col("b.key"))
    once = ~F.col("b.stray") | (F.col("a.h") < F.col("b.h"))
    close = F.bit_count(F.col("a.h").bitwiseXOR(F.col("b.h"))) <= radius
    first = F.col("a.h") < F.col("b.h")
    return a.join(b, same & once & (F.col("a.label") != F.col("b.label")) & close).select(
        F.least("a.h", "b.h").alias("a"), F.greatest("a.h", "b.h").alias("b"),
        F.when(first, F.col("a.label")).otherwise(F.col("b.label")).alias("a_label"),
        F.when(first, F.col("b.label")).otherwise(F.col("a.label")).alias("b_label"))


def pairs_across(labelled: DataFrame, radius: int, group_limit: int = 2_000, levels: int = 3) -> DataFrame:
    """(a, b, a_label, b_label): every pair a < b within ``radius`` whose labels differ. ``labelled`` has distinct (h, label).

    Groups in which all agree on the label are settled. A group whose strays times members exceed the square of
    ``group_limit`` goes down a level to finer keys; on the last one all are compared."""
    masks, found = {0: _finer(0, radius)}, []
    members = labelled.select("h", "label", F.lit(0).cast("bigint").alias("mask"))
    for level in range(levels):
        finer = F.create_map(*[x for m, ms in masks.items() for x in (
            F.lit(_signed(m)).cast("bigint"), F.array(*[F.lit(_signed(x)).cast("bigint") for x in ms]))])
        members = members.select("h", "label", F.explode(F.element_at(finer, F.col("mask"))).alias("mask")).withColumn(
            "key", F.col("h").bitwiseAND(F.col("mask")))
        sizes = members.groupBy("mask", "key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("mask", "key").agg(
            F.sum("n").alias("n"), F.max("n").alias("top"), F.max_by("label", F.struct("n", "label")).alias("main")).filter("n > top")
        costly = F.lit(level + 1 < levels) & (
            (F.col("n") - F.col("top")).cast("double") * F.col("n") > float(group_limit) ** 2)
        rows = checkpointed(members.join(sizes, ["mask", "key"]).select(
            "h", "label", "mask", "key", (F.col("label") != F.col("main")).alias("stray"), costly.alias("costly")))
        found.append(_pairs(rows.filter("not costly"), radius))
        members = rows.filter("costly").select("h", "label", "mask")
        if members.isEmpty():
            break
        masks = {x: _finer(x, radius) for ms in masks.values() for x in ms}
    return reduce(DataFrame.unionByName, found).distinct()


def near_pairs(hashes: DataFrame, radius: int = K.HAMMING_MAX, column: str = "simhash",
               group_limit: int = 2_000) -> DataFrame:
    """All pairs (a < b) of distinct non-zero fingerprints within ``radius``, exactly."""
    distinct = _distinct(hashes, column)
    return pairs_across(distinct.withColumn("label", F.col("h")), radius, group_limit).select("a", "b")


def near_links(hashes: DataFrame, radius: int = K.HAMMING_MAX, width: int = 6) -> DataFrame:
    """(a, b): fingerprints that are equal outside one of the blocks of at most ``width`` and ``radius`` bits, each with the
    least of its group. A group has no more members than a block has values, a fingerprint no more groups than blocks."""
    blocks = _split(list(range(64)), -(-64 // max(min(radius, width), 1))) if radius else []
    outside = F.array(*[F.lit(_signed(((1 << 64) - 1) ^ m)).cast("bigint") for m in blocks]).cast("array<bigint>")
    groups = hashes.select("h", F.explode(outside).alias("mask")).groupBy(
        "mask", F.col("h").bitwiseAND(F.col("mask")).alias("key")).agg(F.collect_list("h").alias("hs"))
    least = groups.filter(F.size("hs") > 1).select(F.array_min("hs").alias("a"), F.explode("hs").alias("b"))
    return least.filter("a <> b").distinct()


def near_components(hashes: DataFrame, radius: int = K.HAMMING_MAX, column: str = "simhash") -> DataFrame:
    """(node, root) of every distinct non-zero fingerprint: root is the least that close pairs lead to.

    Links contract dense balls first; pairs are sought between what is left apart, and joined as edges of labels."""
    distinct = checkpointed(_distinct(hashes, column))
    tied = connected_components(near_links(distinct, radius))
    labelled = checkpointed(distinct.join(tied, distinct["h"] == tied["node"], "left").select(
        "h", F.coalesce("root", "h").alias("label")))
    across = pairs_across(labelled, radius).select(
        F.least("a_label", "b_label").alias("a"), F.greatest("a_label", "b_label").alias("b"))
    roots = connected_components(across)
    return labelled.join(roots, labelled["label"] == roots["node"], "left").select(
        F.col("h").alias("node"), F.coalesce("root", "label").alias("root"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an undirected edge list (a, b): root is the smallest node.

    Alternates large-star and small-star steps until the edges stop changing; a chain shortens by a
    constant factor per step, so the loop ends for every input. Each step is one
    grouped minimum and one join, and is checkpointed.
    """
    current = checkpointed(edges.select("a", "b").distinct())
    previous = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(
            F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter(F.col("a") != F.col("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low2 = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.filter(F.col("a") != F.col("b")).unionByName(
            low2.select("a", F.col("m").alias("b")))
        current = checkpointed(small.distinct())
        state = current.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1_000_003)
        ).first()
        if state == previous:
            break
        previous = state
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def note_clusters(notes: DataFrame, window_ms: int, now_ms: int,
                  radius: int = K.HAMMING_MAX) -> DataFrame:
    """(simhash, canonical, members) for every cluster of at least two window notes.

    The canonical note is the most liked one, then the one with the greatest id.
    """
    window = notes.filter((F.col("publish_time_ms") >= now_ms - window_ms) & (F.col("simhash") != 0))
    best = F.struct(F.coalesce("liked_count", F.lit(0)).alias("likes"), "note_id")
    groups = checkpointed(window.groupBy("simhash").agg(
        F.max(best).alias("best"), F.count(F.lit(1)).alias("n")))
    roots = near_components(groups, radius)
    labelled = groups.join(roots, groups["simhash"] == roots["node"], "left").select(
        "simhash", "best", "n", F.coalesce("root", "simhash").alias("root"))
    clusters = labelled.groupBy("root").agg(
        F.max("best").alias("top"), F.sum("n").alias("members")).filter("members > 1")
    return labelled.select("simhash", "root").join(clusters, "root").select(
        "simhash", F.col("top.note_id").alias("canonical"), "members", "root")


def mark_notes(notes: DataFrame, window_ms: int, now_ms: int, radius: int = K.HAMMING_MAX) -> DataFrame:
    """Notes with ``dup_group_id`` recomputed inside the window and left alone outside it."""
    if "dup_group_id" not in notes.columns:
        notes = notes.withColumn("dup_group_id", F.lit(None).cast("string"))
    clusters = note_clusters(notes, window_ms, now_ms, radius).select("simhash", "canonical")
    inside = F.col("publish_time_ms") >= now_ms - window_ms
    pointer = F.when(F.col("canonical") != F.col("note_id"), F.col("canonical"))
    return notes.join(clusters, "simhash", "left").withColumn(
        "dup_group_id", F.when(inside, pointer).otherwise(F.col("dup_group_id"))
    ).drop("canonical")


def mark_exact(items: DataFrame, norm: str, item_id: str, likes: str, time: str, window_ms: int,
               now_ms: int, source: str | None = None) -> DataFrame:
    """Items with ``dup_group_id`` set to the most liked, then oldest, item of the same
    normalised text in the window. NULL text is never a duplicate. ``source`` names the column that ``norm`` is made of: rows then
    find their group by the digest of that, and no text is normalised twice."""
    if "dup_group_id" not in items.columns:
        items = items.withColumn("dup_group_id", F.lit(None).cast("string"))
    inside = F.col(time) >= now_ms - window_ms
    # Texts meet by their digest: none is sorted or a key of a shuffle. What is narrow, a row for each different text, is written before
    # it is filtered, as a filter on the digest would be pushed down to the texts and normalise each of them once more.
    digest = F.sha2(F.col(norm), 256)
    own = F.coalesce(F.sha2(F.col(source), 256), F.lit("")) if source else digest
    texts = checkpointed(items.filter(inside).groupBy(own.alias("_own"), digest.alias("_digest")).agg(
        F.min(F.struct((-F.coalesce(likes, F.lit(0))).alias("l"), F.col(time).alias("t"), F.col(item_id).alias("id"))).alias("first"),
        F.count(F.lit(1)).alias("_n"),
    )).filter("_digest IS NOT NULL")
    groups = texts.groupBy("_digest").agg(F.min("first").alias("first"), F.sum("_n").alias("_n")).filter("_n > 1")
    pointers = texts.select("_own", "_digest").join(groups, "_digest").select("_own", F.col("first.id").alias("canonical"))
    pointer = F.when(F.col("canonical") != F.col(item_id), F.col("canonical"))
    return items.withColumn("_own", own).join(pointers.hint("shuffle_hash"), "_own", "left").withColumn(
        "dup_group_id", F.when(inside, pointer).otherwise(F.col("dup_group_id"))
    ).select(norm, *[c for c in items.columns if c != norm])


def mark_comments(comments: DataFrame, window_ms: int, now_ms: int) -> DataFrame:
    return mark_exact(comments, "content_norm_hash", "comment_id", "like_count", "create_time_ms",
                      window_ms, now_ms)


def cluster_sizes(items: DataFrame, item_id: str, time: str, window_ms: int, now_ms: int) -> DataFrame:
    """(item, cluster_size) keyed by the canonical item of the window."""
    return items.filter(F.col(time) >= now_ms - window_ms).groupBy(
        F.coalesce("dup_group_id", item_id).alias(item_id)
    ).agg(F.count(F.lit(1)).alias("cluster_size"))


def recompute(notes: DataFrame, comments: DataFrame, window_ms: int, now_ms: int,
              radius: int = K.HAMMING_MAX) -> tuple[DataFrame, DataFrame]:
    """Both passes."""
    return mark_notes(notes, window_ms, now_ms, radius), mark_comments(comments, window_ms, now_ms)


def dup_counts(notes: DataFrame, comments: DataFrame, window_ms: int, now_ms: int) -> DataFrame:
    """(note_dups, comment_dups) of the window in one row."""
    n = notes.filter(F.col("publish_time_ms") >= now_ms - window_ms).select(
        F.lit("note_dups").alias("k"), "dup_group_id")
    c = comments.filter(F.col("create_time_ms") >= now_ms - window_ms).select(
        F.lit("comment_dups").alias("k"), "dup_group_id")
    return n.unionByName(c).agg(*[
        F.count_if((F.col("k") == k) & F.col("dup_group_id").isNotNull()).alias(k)
        for k in ("note_dups", "comment_dups")
    ])
