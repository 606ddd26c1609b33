"""Operators for training-data pipelines: deduplication, packing, scoring, scanning, tokenizing and search."""
