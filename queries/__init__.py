"""Queries over the shared test tables, each with its equivalent SQL where SQL can say it."""

from __future__ import annotations

from importlib import import_module

MODULES = ["text", "dictionary", "mentions", "heat", "boards", "snapshots", "dedup", "evidence",
           "ratings", "scoreboard", "ledger", "logs", "landing", "streams", "files"]


def load():
    """(queries, oracles) of every module."""
    queries, oracles = {}, {}
    for name in MODULES:
        module = import_module(f"queries.{name}")
        queries.update(module.Q.queries)
        oracles.update(module.Q.oracles)
    return queries, oracles
