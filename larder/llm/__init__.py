"""Operators of a training-data pipeline: extraction, identification, filtering, deduplication and packing."""
