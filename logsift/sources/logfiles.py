"""Text sources: directories of log files, single files, any line-shaped table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.functions.text import drop_undecodable, is_blank


def pin_splits(spark: SparkSession) -> None:
    """Fix how files are split for as long as the session lives.

    By default the split size follows the number of live cores. A lost executor
    would then give the second pass over the files other blocks than the first.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))


def scan_text(spark: SparkSession, path: str, missing: str | None = None) -> DataFrame:
    """One row per line with its place: file, block within the file, row within the task.

    ``_row`` only rises within a task. Lines of one block stay together in one
    task, so their differences are positions inside the block.
    """
    pin_splits(spark)
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(missing or path) from error
        raise
    return lines.select(
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_path").alias("_path"),  # files of one name in several folders are told apart
        F.col("_metadata.file_block_start").alias("_block"),
        F.col("value").alias("raw_text"),
    )


def number_rows(scanned: DataFrame) -> DataFrame:
    """Fix ``_row`` after the filters that decide which lines count."""
    return scanned.withColumn("_row", F.monotonically_increasing_id())


def scan_log_dir(spark: SparkSession, log_dir: str, glob: str = "*.log") -> DataFrame:
    """Lines of the matching files directly in ``log_dir``; only empty lines go.

    Lines of white space stay, as the directory source keeps them.
    """
    directory = log_dir.rstrip("/")
    scanned = scan_text(spark, f"{directory}/{glob}", missing=f"Not found in {directory}")
    return number_rows(scanned.where(F.length("raw_text") > 0))


def scan_text_file(spark: SparkSession, path: str) -> DataFrame:
    """Lines for labelling: undecodable bytes dropped, blank lines dropped."""
    scanned = scan_text(spark, path).withColumn("raw_text", drop_undecodable(F.col("raw_text")))
    return number_rows(scanned.where(~is_blank(F.col("raw_text"))))
