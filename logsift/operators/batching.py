"""Fixed-size batches over a dense index, and what is computed per batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions.rules import error_flag
from logsift.functions.text import clamp_batch_size
from logsift.schemas import DEFAULT_BATCH_SIZE


def assign_batches(indexed: DataFrame, batch_size: int = DEFAULT_BATCH_SIZE) -> DataFrame:
    """Batches run across file boundaries; only the last one may be short."""
    size = clamp_batch_size(batch_size)
    return indexed.withColumn("batch_id", F.expr(f"index div {size}L"))


def collect_entries(batched: DataFrame) -> DataFrame:
    """One row per batch; a group never holds more than one batch of lines."""
    entry = F.struct("index", "source_file", "raw_text")
    return batched.groupBy("batch_id").agg(F.sort_array(F.collect_list(entry)).alias("entries"))


def rendered(entry: Column) -> Column:
    return F.concat(F.lit("["), entry["index"].cast("string"), F.lit("] "), entry["raw_text"])


def batch_text(entries: Column) -> Column:
    return F.array_join(F.transform(entries, rendered), "\n")


def batch_counts(batched: DataFrame) -> DataFrame:
    """Lines per batch; combined before the shuffle."""
    return batched.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_lines"))


def rule_verdicts(batched: DataFrame, text: str = "raw_text") -> DataFrame:
    """A batch is an error if any of its lines is; combined before the shuffle."""
    flagged = batched.withColumn("_error", error_flag(F.col(text), F.upper(F.col(text))))
    return flagged.groupBy("batch_id").agg(
        F.bool_or("_error").alias("error_found"), F.count(F.lit(1)).alias("n_lines")
    )


def entry_verdicts(batches: DataFrame) -> DataFrame:
    """The same rule where the lines are already collected: no shuffle at all.

    A line is upper-cased once; inside one lambda every keyword would do it again.
    """
    cased = F.transform("entries", lambda e: F.struct(e["raw_text"].alias("raw"), F.upper(e["raw_text"]).alias("upper")))
    return batches.withColumn("error_found", F.exists(cased, lambda e: error_flag(e["raw"], e["upper"])))


def summary(results: DataFrame) -> DataFrame:
    """The four columns of a batch summary; names default to null."""
    columns = [F.col("batch_id").cast("long").alias("batch_id"), F.col("error_found")]
    for name in ("model_name", "embedder_model_name"):
        present = F.col(name) if name in results.columns else F.lit(None)
        columns.append(present.cast("string").alias(name))
    return results.select(*columns)
