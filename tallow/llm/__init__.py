"""Operators for training-data pipelines: deduplication, packing, tokenising, extraction, filtering, language."""
