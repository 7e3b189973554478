"""Spark-native discrepancy analytics for caption + media corpora."""

from tonegap.constants import FEATURE_NAMES, LABELS

__all__ = ["FEATURE_NAMES", "LABELS"]
