"""Result files: JSON lines, JSON arrays, labelled records and the metrics report."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.functions.rules import DEFAULT_SERVICE, labelled_record
from logsift.operators.batching import summary
from logsift.schemas import SUMMARY
from logsift.staging import stage


def json_text(*columns: str | Column) -> Column:
    """A compact JSON object; null members are written out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def append_summaries(results: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON line per batch with all four keys."""
    summary(results).write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUMMARY).json(path)


def array_lines(items: DataFrame, order: list[str]) -> DataFrame:
    """The lines of one JSON array over ``json`` strings, in order.

    The first line opens the array, the last one closes it, and the others
    start with a comma. Only the smallest and the largest key are looked up
    beforehand, so lines can be written by any number of tasks.
    """
    key = F.struct(*order)
    ends = items.agg(F.min(key).alias("first"), F.max(key).alias("last")).first()

    def at(end: str) -> Column:
        row = ends[end]
        return reduce(lambda a, b: a & b, [F.col(c) == F.lit(row[c]) for c in order]) if row else F.lit(False)

    opened = F.when(at("first"), F.lit("[")).otherwise(F.lit(","))
    closed = F.when(at("last"), F.lit("]")).otherwise(F.lit(""))
    return items.select(*order, F.concat(opened, F.col("json"), closed).alias("line"))


def write_json_array(items: DataFrame, order: list[str], path: str) -> None:
    """Text parts that form one JSON array when read in name order."""
    lines = array_lines(stage(items, "items"), order)
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)


def summary_items(results: DataFrame, run: int = 0) -> DataFrame:
    """Summaries as array items; ``run`` orders the results of several runs."""
    rows = summary(results)
    return rows.select(F.lit(run).cast("long").alias("run"), F.col("batch_id").alias("at"), json_text(*rows.columns).alias("json"))


def existing_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of an array document written earlier; anything but an array counts as none.

    A document is one value, so one task parses it, in Python: Spark's JSON value
    has a size limit and refuses repeated keys and NaN. Results that keep growing
    belong in JSON lines, from which the array is derived.
    """

    def items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for text in (t for batch in batches for t in batch["value"]):
            try:
                document = json.loads(text)
            except ValueError:
                continue
            found = document if isinstance(document, list) else []
            for start in range(0, len(found), 10_000):
                part = [json.dumps(item, ensure_ascii=False, separators=(",", ":")) for item in found[start : start + 10_000]]
                yield pd.DataFrame({"run": -1, "at": range(start, start + len(part)), "json": part})

    return spark.read.text(path, wholetext=True).mapInPandas(items, "run long, at long, json string")


def append_json_array(results: DataFrame, existing: str, path: str) -> None:
    """A new array: the items of the ``existing`` document, then the new summaries."""
    items = existing_items(results.sparkSession, existing).unionByName(summary_items(results))
    write_json_array(items, ["run", "at"], path)


def write_labelled(labelled: DataFrame, path: str, service_name: str = DEFAULT_SERVICE) -> None:
    """One nested record per line; non-ASCII text stays as it is."""
    labelled.select(labelled_record(service_name).alias("r")).select("r.*").write.mode("overwrite").json(path)


def write_labelled_array(labelled: DataFrame, order: list[str], path: str, service_name: str = DEFAULT_SERVICE) -> None:
    """The same records as one JSON array, in the order of the given columns."""
    items = labelled.select(*order, F.to_json(labelled_record(service_name)).alias("json"))
    write_json_array(items, order, path)


def metrics_json(metrics: DataFrame) -> DataFrame:
    """The metrics record as one JSON object."""
    return metrics.select(json_text(*metrics.columns).alias("report"))


def running_totals(per_batch: DataFrame) -> DataFrame:
    """Job totals of the per-batch counts: batches, lines and batches in error."""
    return per_batch.agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.sum("n_lines").alias("n_lines"),
        F.count_if("error_found").alias("n_error_batches"),
    )
