"""Operators of a training-data pipeline: dedup, formatting, packing, quality, archives, toxicity."""
