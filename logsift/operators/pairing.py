"""Putting two label lists side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_by_position(reference: DataFrame, candidate: DataFrame | None = None) -> DataFrame:
    """``(pos, y_true, y_pred)`` of two ``(pos, label)`` tables with dense positions.

    Without a second list the first is compared with itself, and needs no join.
    ``_unpaired`` is the position where one list is longer; evaluation raises on
    it in the same pass, so no list is counted on its own first.
    """
    if candidate is None:
        return reference.select("pos", F.col("label").alias("y_true"), F.col("label").alias("y_pred"))
    left = reference.select("pos", F.col("label").alias("y_true"), F.lit(True).alias("_left"))
    right = candidate.select("pos", F.col("label").alias("y_pred"), F.lit(True).alias("_right"))
    lonely = F.col("_left").isNull() | F.col("_right").isNull()
    return left.join(right, "pos", "full_outer").select(
        "pos", "y_true", "y_pred", F.when(lonely, F.col("pos")).alias("_unpaired")
    )


def pair_by_key(reference: DataFrame, candidate: DataFrame, key: str = "batch_id") -> DataFrame:
    """Pairs of the rows that share ``key``; both sides have one row per key."""
    left = reference.select(key, F.col("label").alias("y_true"))
    return left.join(candidate.select(key, F.col("label").alias("y_pred")), key)
