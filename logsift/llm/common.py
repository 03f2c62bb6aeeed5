"""Column expressions and joins that several operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.staging import stage

WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
_TRIM = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(_UPPER, _LOWER)
# A joined side is broadcast only if its counted rows times its row width stay below this.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text; none for null or blank texts."""
    trimmed = F.btrim(text, F.lit(_TRIM))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE))


def fold(text: Column) -> Column:
    """``text`` with A-Z in lower case, other letters as they are."""
    return F.translate(text, _UPPER, _LOWER)


def shingles(tokens: Column, size: int = 5) -> Column:
    """64-bit hashes of the word windows; a shorter sequence is one window, no word gives none."""
    n = F.size(tokens)
    window = F.transform(
        F.sequence(F.lit(1), n - (size - 1)),
        lambda i: F.xxhash64(*[F.get(tokens, i + (j - 1)) for j in range(size)]),
    )
    whole = F.array(F.xxhash64(tokens))
    return F.when(n >= size, window).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))


def with_shingles(rows: DataFrame, text: str, out: str) -> DataFrame:
    """``rows`` with the set of shingle hashes of a folded text.

    The words are a column of their own: inside the windows' lambda they would
    be split anew for every window.
    """
    cut = rows.withColumn("_words", words(fold(F.col(text))))
    return cut.withColumn(out, F.array_distinct(shingles(F.col("_words")))).drop("_words")


def row_key(*columns: str) -> Column:
    """A key of the row's content: equal rows share it, null and empty differ.

    Two hashes of different seeds, so that 10^10 rows do not collide.
    """
    cells = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    return F.concat_ws("-", F.hex(F.xxhash64(*cells)), F.hex(F.xxhash64(F.lit(1), *cells)))


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo ``modulus``; null ids give null."""
    return F.crc32(F.col(column).cast("string")) % modulus


def attach(facts: DataFrame, facts_key: str, small: DataFrame, width: int, how: str = "left") -> DataFrame:
    """Join a table with one row per key that is usually small.

    ``small`` is written first and counted: below the byte bound (``width``
    bytes a row) it is broadcast, otherwise both sides are shuffled by the key
    and Spark splits hot keys, which needs no aggregate between shuffle and join.
    """
    small = stage(small, "attach")
    if small.count() * width <= BROADCAST_BYTES:
        small = F.broadcast(small)
    return facts.join(small, facts_key, how)
