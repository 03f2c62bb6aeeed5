"""The corpus pipeline: documents in, a mixed training corpus out.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept.
The result has the columns of ``documents`` and what the mix decided.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm import decontaminate, langid, linededup, mixing, neardup
from logsift.llm.common import WORD, crc_mod, table
from logsift.staging import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Below this pooled probability the network found no language.
LEAST_SCORE = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those of no recognisable language."""
    net = langid.fit(docs.filter(F.coalesce(crc_mod("doc_id", 4) != 2, F.lit(False))))
    found = langid.identify(docs, net)
    if net is None:  # nothing is labelled: only the test for letters remains
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).select(*COLUMNS)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of line runs; documents that lose their last word go."""
    edited = linededup.delete_copies(docs)
    left = edited.filter((F.col("n_deleted") == 0) | F.col("text").rlike(WORD))
    return left.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near duplicates."""
    return neardup.keep_first(docs).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources; documents of which nothing is taken go."""
    return mixing.mixed_rows(docs).select(*COLUMNS, "size", "source_size", "target", "taken")


STAGES = [
    ("language_id", known_language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", benchmark_decontamination),
    ("mix", source_mix),
]

# Language identification is a trained network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
