"""Operators for training-data pipelines: deduplication, archives, classifiers, tokens, extraction and search."""
