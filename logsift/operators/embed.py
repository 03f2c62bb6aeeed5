"""Batch text to unit vectors: user encoder, or hashed template tokens."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.functions.text import log_template
from logsift.schemas import DEFAULT_DIMENSION

HASHED_ENCODER = "hashed-template-tokens"


def hashed_embedding(
    df: DataFrame, text: str, vector: str = "vec", dimension: int = DEFAULT_DIMENSION
) -> DataFrame:
    """Token counts of the masked text, hashed to ``dimension`` and scaled to length 1."""
    masked = df.withColumn("_template", log_template(F.col(text)))
    tokens = RegexTokenizer(inputCol="_template", outputCol="_tokens", pattern="[^\\p{L}\\p{N}_<>]+")
    counts = HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=dimension)
    scaled = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0)
    result = scaled.transform(counts.transform(tokens.transform(masked)))
    return result.withColumn(vector, vector_to_array("_unit", "float32")).drop(
        "_template", "_tokens", "_counts", "_unit"
    )


def encoder_embedding(
    df: DataFrame,
    text: str,
    factory: Callable[[], Callable[[list[str]], np.ndarray]],
    vector: str = "vec",
    elapsed: str | None = None,
) -> DataFrame:
    """Vectors of a user encoder, built once per worker and called per Arrow batch.

    ``elapsed`` names a column for each row's part of the encoder's time, in milliseconds.
    """

    def vectors(batches: Iterator[pd.Series]) -> Iterator[tuple[pd.Series, float]]:
        encoder = factory()
        for texts in batches:
            start = time.perf_counter()
            rows = np.asarray(encoder(texts.tolist()), dtype=np.float64).reshape(len(texts), -1)
            spent = (time.perf_counter() - start) * 1000.0
            length = np.linalg.norm(rows, axis=1, keepdims=True)
            rows = rows / np.where(length == 0, 1.0, length)
            yield pd.Series(list(rows.astype(np.float32))), spent / max(len(texts), 1)

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for made, _ in vectors(batches):
            yield made

    @F.pandas_udf("vec array<float>, ms double")
    def encode_timed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for made, ms in vectors(batches):
            yield pd.DataFrame({"vec": made, "ms": ms})

    if elapsed is None:
        return df.withColumn(vector, encode(F.col(text)))
    timed = df.withColumn("_encoded", encode_timed(F.col(text)))
    return timed.withColumns({vector: F.col("_encoded.vec"), elapsed: F.col("_encoded.ms")}).drop("_encoded")
