"""The write path as one DAG: dedup, mentions, statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from .. import constants as K
from ..operators import dedup, heat, matching
from ..operators.dictionary import Dictionary, classified
from ..operators.trend import snapshot_rows


@dataclass
class Cycle:
    notes: DataFrame
    comments: DataFrame
    mentions: DataFrame
    stats: DataFrame        # window, ticker, …
    snapshot: DataFrame


def non_stocks(dictionary: Dictionary) -> DataFrame:
    return classified(dictionary.stocks).filter("is_non_stock").select("ticker")


def run_cycle(notes: DataFrame, comments: DataFrame, dictionary: Dictionary, now_ms: int, *,
              tracked: DataFrame | None = None, run_id: int | None = None,
              fresh_ms: int = K.FRESH_HOURS * K.HOUR_MS, context_ms: int = K.CONTEXT_HOURS * K.HOUR_MS,
              radius: int = K.HAMMING_MAX) -> Cycle:
    """``notes`` must carry ``simhash``. Duplicates and mentions use the context window, boards
    the fresh one; both sets of statistics come from one scan."""
    marked_notes, marked_comments = dedup.recompute(notes, comments, context_ms, now_ms, radius)
    mentions = matching.extract_mentions(marked_notes, marked_comments, dictionary, context_ms, now_ms, tracked, run_id, facts=True)
    stats = heat.compute_windows(mentions, marked_notes, marked_comments,
                                 {"fresh": fresh_ms, "context": context_ms}, now_ms, non_stocks(dictionary),
                                 prune_sources=True)
    fresh = stats.filter("window = 'fresh'").drop("window")
    return Cycle(marked_notes, marked_comments, mentions, stats, snapshot_rows(fresh, run_id, now_ms))
