"""Registration helper and the per-call view of the test tables."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from crowdgauge import fixtures
from crowdgauge.operators import dedup, evidence, heat, matching
from crowdgauge.operators.facts import with_facts
from crowdgauge.plans.cycle import non_stocks
from crowdgauge.session import ensure_checkpoint_dir
from crowdgauge.sources import corpus, sample_tables

from .sqlparts import sql


# Tables several queries read are written once per session and folder, as a pipeline would.
WRITTEN: dict[tuple, DataFrame] = {}
FILES = 32  # files of a table of texts


class Tables:
    """The test tables as this library's tables, built on demand."""

    now = corpus.NOW_MS
    context = corpus.CONTEXT_MS
    fresh = corpus.FRESH_MS

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def written(self, name: str, build, key: str | None = None) -> DataFrame:
        """A table in the shared folder, as a pipeline stores it. Tables of texts are dealt to files by a hash of ``key``, so
        that whatever reads them is spread over tasks however the source was laid out."""
        known = (self.spark.sparkContext.applicationId, self.dir, name)
        if known not in WRITTEN:
            df = build()
            path = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
            (df.repartition(FILES, key) if key else df).write.parquet(path)
            WRITTEN[known] = self.spark.read.schema(df.schema).parquet(path)
        return WRITTEN[known]

    def raw(self, name: str) -> DataFrame:
        return corpus.table(self.spark, self.dir, name)

    def __getattr__(self, name: str):
        maker = getattr(sample_tables, name, None)
        if maker is None:
            raise AttributeError(name)
        return maker(self.spark, self.dir)

    @cached_property
    def dictionary(self):
        return fixtures.dictionary(self.spark)

    @cached_property
    def tracked(self) -> DataFrame:
        return fixtures.tracked(self.spark)

    @cached_property
    def outside(self) -> DataFrame:
        return non_stocks(self.dictionary)

    @cached_property
    def ingested_notes(self) -> DataFrame:
        """Notes as ingest stores them, before any pass over them."""
        return self.written("ingested-notes", lambda: corpus.notes(self.spark, self.dir), "note_id")

    @cached_property
    def ingested_comments(self) -> DataFrame:
        return self.written("ingested-comments", lambda: corpus.comments(self.spark, self.dir), "comment_id")

    @cached_property
    def notes(self) -> DataFrame:
        return self.written("notes", lambda: sample_tables.marked_notes(self.spark, self.dir, self.ingested_notes), "note_id")

    @cached_property
    def comments(self) -> DataFrame:
        return self.written("comments", lambda: sample_tables.marked_comments(self.spark, self.dir, self.ingested_comments), "comment_id")

    @cached_property
    def mentions(self) -> DataFrame:
        """Mentions of the context window, written once as the mention table is; built from the
        unmarked tables, which hold the same text."""
        return self.written("mentions", lambda: matching.extract_mentions(
            self.ingested_notes, self.ingested_comments, self.dictionary, self.context, self.now, self.tracked, 7))

    @cached_property
    def told_mentions(self) -> DataFrame:
        """Mentions with their facts, as a mention table stores them."""
        return self.written("told-mentions", lambda: with_facts(self.mentions, self.ingested_notes, self.ingested_comments))

    @cached_property
    def stats(self) -> DataFrame:
        return self.written("stats", lambda: heat.compute_stats(
            self.told_mentions, self.notes, self.comments, self.context, self.now, self.outside))

    @cached_property
    def windows(self) -> DataFrame:
        return self.written("windows", lambda: heat.compute_windows(
            self.told_mentions, self.notes, self.comments, {"fresh": self.fresh, "context": self.context},
            self.now, self.outside))

    @cached_property
    def items(self) -> DataFrame:
        return self.written("items", lambda: evidence.gather(
            self.told_mentions, self.notes, self.comments, self.context, self.now))

    @cached_property
    def fingerprinted(self) -> DataFrame:
        return self.written("fingerprinted", lambda: dedup.fingerprinted(
            self.ingested_notes, "word", 3, "md5"))


class Registry:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def add(self, name: str, needs: str = "", body: str | None = None):
        """Register a function (Tables) -> DataFrame; ``body`` is its SQL over the parts it needs."""

        def wrap(fn):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return fn(Tables(spark, sf_dir))

            self.queries[name] = run
            if body is not None:
                self.oracles[name] = sql(needs.split(), body)
            return fn

        return wrap
