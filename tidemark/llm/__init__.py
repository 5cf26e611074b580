"""Operators of a training-data pipeline: deduplication, filtering, scoring, counting and packing of texts."""
