"""Scoring label files and label tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from logsift.operators.metrics import evaluate
from logsift.operators.pairing import pair_by_key, pair_by_position
from logsift.schemas import DEFAULT_LABEL_KEY
from logsift.sources.labelfiles import read_labels


def compare_files(
    spark: SparkSession,
    reference: str,
    candidate: str | None = None,
    reference_key: str | None = None,
    candidate_key: str | None = None,
    zero_division: float = 0.0,
    average: str = "binary",
    label_key: str = DEFAULT_LABEL_KEY,
    positive_label: Any = True,
) -> DataFrame:
    """The metrics record of two label files, paired by position.

    Without a second file the first is compared with itself. Lists of different
    length make the query fail with the first unpaired position.
    """
    truth = read_labels(spark, reference, reference_key, label_key)
    if candidate is None and reference_key == candidate_key:
        pairs = pair_by_position(truth)
    else:
        other = read_labels(spark, candidate or reference, candidate_key, label_key)
        pairs = pair_by_position(truth, other)
    return evaluate(pairs, zero_division, average, positive_label)


def compare_tables(
    reference: DataFrame, candidate: DataFrame, key: str = "batch_id", **options
) -> DataFrame:
    """The metrics record of two ``(key, label)`` tables."""
    return evaluate(pair_by_key(reference, candidate, key), **options)
