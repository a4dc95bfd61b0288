"""License scans: phrase places in whole texts, and an exact set-similarity join of text blocks with
license templates.

DataFrame functions only. The join follows the prefix-filter scheme for containment
``|block & template| >= threshold * |template|``:

* Global order: template tokens sorted by how many blocks of the corpus hold them, rarest first. A token
  outside all templates cannot be in an intersection, so it needs no place in the order.
* Prefix: a template that is contained to the threshold shares one of its first
  ``|T| - need + 1`` tokens, so only these meet the blocks.
* Length: a block with fewer than ``need`` template tokens is left out before the join.
* Position: of the pairs that meet, one is kept if the tokens left after the first shared place still
  can reach ``need``.

The rest are verified by the size of the intersection. A block is a line. With ``across_lines`` windows as long as the template
are looked at as well, over line ends: they start at each word that the template holds, in texts that hold enough of the
template's words at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, id_and_text, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases of the base labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Sentences by which texts state or carry a licence.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "gpl-3-notice": "This work is licensed under the GNU General Public License, version 3",
    "mit-notice": "Released under the MIT License",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
                 "and associated documentation files, to deal in the Software without restriction",
    "apache-2.0-grant": "you may not use this file except in compliance with the License. "
                        "You may obtain a copy of the License at",
    "gpl-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the "
                 "GNU General Public License as published by the Free Software Foundation",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                 "provided that the following conditions are met",
    "all-rights-reserved": "All rights reserved",
}
THRESHOLD_PERCENT = 80
LINE_END = r"\n"


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def need_of(size: Column, percent: int) -> Column:
    """Tokens that must be shared: the threshold share of the template, rounded up."""
    return F.ceil(size * percent / F.lit(100)).cast("int")


def template_table(spark, templates: dict[str, str], percent: int) -> DataFrame:
    """(label, tokens, size, need): the templates are an argument, so their number is the caller's."""
    rows = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(v).alias("body")) for k, v in templates.items()])
    return (spark.range(1).select(F.inline(rows.cast("array<struct<label:string,body:string>>")))
            .select("label", F.array_distinct(words(ascii_lower(F.col("body")))).alias("tokens"))
            .withColumn("size", F.size("tokens")).withColumn("need", need_of(F.col("size"), percent)))


def template_words(body: str) -> list[str]:
    import re

    return re.findall(WORD, re.sub("[A-Z]+", lambda m: m[0].lower(), body))


def template_bounds(templates: dict[str, str], percent: int) -> tuple[list[str], int]:
    """All template tokens, and the fewest that any template needs."""
    sets = [set(template_words(body)) for body in templates.values()]
    return sorted(set().union(*sets)), min((-(-len(s) * percent // 100) for s in sets), default=1)


def lines_of(norm: Column, vocabulary: list[str], end: str = LINE_END) -> Column:
    """Per line, or what else ``end`` ends: its number, how many words it has, and which template tokens are among them."""
    split = F.transform(F.split(norm, end), lambda line: words(line))
    return F.transform(split, lambda w, i: F.struct(
        i.alias("block"), F.size(w).alias("n"),
        F.array_distinct(F.filter(w, lambda x: x.isin(vocabulary))).alias("tokens")))


NEAR = "array<struct<label:string,shared:int,size:int>>"


def near_windows(norm: Column, held: Column, templates: dict[str, str], percent: int) -> Column:
    """Array of (label, shared, size): templates that some window of as many words holds to the threshold. ``held`` are the
    template tokens of the whole text; only texts that hold enough of them are cut into words again."""
    def near(label: str, all_words: list[str]) -> Column:
        tokens = sorted(set(all_words))
        literal, need = F.array(*map(F.lit, tokens)), -(-len(tokens) * percent // 100)

        def shares(w: Column) -> Column:
            starts = F.filter(F.transform(w, lambda x, i: F.when(F.array_contains(literal, x), i + 1)), lambda i: i.isNotNull())
            return F.transform(starts, lambda i: F.size(F.array_intersect(F.slice(w, i, len(all_words)), literal)))

        best = F.when(F.size(F.array_intersect(held, literal)) >= need, F.array_max(F.flatten(F.transform(F.array(words(norm)), shares))))
        row = F.array(F.struct(F.lit(label).alias("label"), best.alias("shared"), F.lit(len(tokens)).alias("size")))
        return F.filter(row, lambda x: F.coalesce(x["shared"] >= need, F.lit(False)))

    return F.concat(F.array().cast(NEAR), *[near(label, w) for label, body in templates.items() if (w := template_words(body))])


def phrase_places(tokens: Column, phrases: dict[str, str]) -> Column:
    """Array of (place, label): every place where the words of a phrase stand one after the other."""
    def places(phrase: str, label: str) -> Column:
        parts = phrase.split(" ")
        hits = F.filter(F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda i: F.forall(
            F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in enumerate(parts)]),
            lambda p: F.coalesce(F.get(tokens, i + p["k"]) == p["w"], F.lit(False))))
        return F.transform(hits, lambda i: F.struct(i.cast("long").alias("place"), F.lit(label).alias("label")))

    return F.concat(*[places(p, label) for p, label in phrases.items()])


def similar_blocks(blocks: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, row, block, label, shared, size): the pairs that meet the threshold, by prefix, length
    and position. ``blocks`` are (doc_id, row, block, tokens)."""
    counts = blocks.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("blocks"))
    per_token = templates.select("label", F.explode("tokens").alias("token")).join(counts, "token", "left").select(
        "label", F.struct(F.coalesce("blocks", F.lit(0)).alias("blocks"), "token").alias("rank"))
    ordered = per_token.groupBy("label").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    templates = templates.join(ordered, "label").withColumn("ranked", F.col("ranks.token"))
    prefixes = templates.select("label", "size", "need", "ranked", F.posexplode(
        F.slice("ranked", F.lit(1), F.col("size") - F.col("need") + 1)).alias("place", "token"))
    # The prefixes are as large as the caller's templates, which stand in the call: a size known beforehand.
    met = (blocks.withColumn("token", F.explode("tokens")).join(F.broadcast(prefixes), "token")
           .filter("size(tokens) >= need and size - place >= need"))
    shared = F.size(F.array_intersect("tokens", "ranked"))
    first = F.array_min(F.transform(F.array_intersect("ranked", "tokens"), lambda t: F.array_position("ranked", t))) - 1
    return (met.filter(F.col("place") == first).withColumn("shared", shared).filter("shared >= need")
            .select("doc_id", "row", "block", "label", "shared", "size"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None,
                 templates: dict[str, str] | None = None, percent: int = THRESHOLD_PERCENT, across_lines: bool = False) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row per input row.

    ``labels`` are the phrase labels and those of templates that some line (with ``across_lines`` also some
    window of the template's length) holds to ``percent`` of the template's different words; ``score`` is the best such share, 0 if none, and 1 wherever a phrase stands.
    Null and empty texts have no words, empty labels and score 0. Repeated rows, and rows that repeat an
    id, get a row each; a null id stays null. Other columns are not read. No rows in, no rows out."""
    spark = docs.sparkSession
    phrases, templates = phrases or PHRASES, TEMPLATES if templates is None else templates
    vocabulary, least = template_bounds(templates, percent)
    norm = F.col("norm")
    tokens = F.when(F.greatest(*[norm.contains(p.split(" ")[0]) for p in phrases]), words(norm))
    places = F.when(F.greatest(*[F.coalesce(F.array_contains(F.col("tokens"), p.split(" ")[0]), F.lit(False))
                                 & F.array_contains(F.col("tokens"), p.split(" ")[-1]) for p in phrases]),
                    phrase_places(F.col("tokens"), phrases))
    lines = F.col("lines")
    near = near_windows(norm, F.array_distinct(F.flatten("lines.tokens")), templates, percent) if across_lines else F.array().cast(NEAR)
    scanned = written(
        id_and_text(docs, id_col, text_col).select("doc_id", ascii_lower(F.col("text")).alias("norm"))
        .select("doc_id", "norm", tokens.alias("tokens"), lines_of(norm, vocabulary).alias("lines"))
        .select("doc_id", F.monotonically_increasing_id().alias("row"),
                F.aggregate(lines, F.lit(0), lambda total, line: total + line["n"]).cast("long").alias("n_words"),
                F.coalesce(places, F.array().cast("array<struct<place:bigint,label:string>>")).alias("places"),
                F.filter(lines, lambda line: F.size(line["tokens"]) >= least).alias("blocks"), near.alias("near")),
        "license-scan")
    blocks = scanned.select("doc_id", "row", F.explode("blocks").alias("b")).select("doc_id", "row", "b.block", "b.tokens")
    pairs = similar_blocks(blocks, template_table(spark, templates, percent))
    pairs = pairs.select("row", "label", "shared", "size").unionByName(scanned.select("row", F.inline("near")))
    found = pairs.groupBy("row").agg(F.collect_set("label").alias("extra"),
                                     F.max(F.col("shared") / F.col("size")).alias("share"))
    none = F.array().cast("array<string>")
    base = F.coalesce(F.array_sort(F.array_distinct("places.label")), none)
    return scanned.join(found, "row", "left").select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.place").alias("first_word"), F.array_max("places.place").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("extra", none))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))
