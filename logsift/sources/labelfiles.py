"""Label files: JSON lines, JSON documents and loose text, as ``(pos, label)``.

``label`` is a variant. Parsing is Spark's own JSON parser; only rows it
refuses go through the Python rewriting of :mod:`logsift.functions.pyjson`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.functions.pyjson import add_parsed
from logsift.functions.text import EXTRA_LINE_BREAKS, is_blank
from logsift.functions.verdict import kind, member
from logsift.operators.indexing import index_scanned
from logsift.schemas import DEFAULT_LABEL_KEY
from logsift.sources.logfiles import number_rows, scan_text
from logsift.staging import stage


def parse_records(df: DataFrame, text: str, literals: bool = True) -> DataFrame:
    """Add ``record``: the variant of a JSON or Python-literal text, null if it is neither."""
    return add_parsed(df, text, "record", literals)


def is_object(record: Column) -> Column:
    return kind(record).startswith("OBJECT")


def record_labels(df: DataFrame, text: str, key: str = DEFAULT_LABEL_KEY) -> DataFrame:
    """Keep the lines that hold an object and add its ``label``; a missing key gives null."""
    parsed = parse_records(df.where(~is_blank(F.col(text))), text)
    return parsed.where(is_object(F.col("record"))).withColumn("label", member(F.col("record"), key)).drop("record")


def loose_labels(
    df: DataFrame, text: str, key: str | None = None, default_key: str = DEFAULT_LABEL_KEY
) -> DataFrame:
    """Any line that parses: objects give ``key`` or else ``default_key``, scalars give themselves.

    The default key is used only where ``key`` is absent; a present null stays.
    """
    record = F.col("record")
    parsed = parse_records(df.where(~is_blank(F.col(text))), text)
    picked = F.coalesce(member(record, key or default_key), member(record, default_key))
    return (
        parsed.where(record.isNotNull())
        .withColumn("label", F.when(is_object(record), picked).otherwise(record))
        .drop("record")
    )


def document_labels(df: DataFrame, text: str, key: str = DEFAULT_LABEL_KEY) -> DataFrame:
    """Labels of whole JSON documents, one row per label with its place ``at``.

    The shape decides: a list under ``key``; ``results`` with objects or
    scalars; a top-level list of objects; a top-level list of anything else.
    Documents of no such shape give no rows (see :func:`has_label_shape`).
    """
    parsed = parse_records(df, text, literals=False)
    record = F.col("record")
    items = lambda value: F.try_variant_get(value, "$", "array<variant>")
    direct = member(record, key)
    results = member(record, "results")
    pick = lambda item: F.when(is_object(item), member(item, key)).otherwise(item)
    listed = items(record)
    listed = F.when(
        F.forall(listed, lambda item: F.coalesce(is_object(item), F.lit(False))),
        F.transform(listed, lambda item: member(item, key)),
    ).otherwise(listed)
    chosen = (
        F.when(is_object(record) & direct.isNotNull(), items(direct))
        .when(is_object(record), F.transform(items(results), pick))
        .otherwise(listed)
    )
    return (
        parsed.withColumn("_labels", chosen)
        .select("*", F.posexplode("_labels").alias("at", "label"))
        .drop("_labels", "record")
    )


def has_label_shape(record: Column, key: str = DEFAULT_LABEL_KEY) -> Column:
    """Whether :func:`document_labels` takes its labels from this document."""
    return (
        kind(record).startswith("ARRAY")
        | member(record, key).isNotNull()
        | F.coalesce(kind(member(record, "results")).startswith("ARRAY"), F.lit(False))
    )


def _positions(labels: DataFrame) -> DataFrame:
    """Parsed once: counting the blocks and numbering the labels read what was written."""
    numbered = stage(number_rows(labels).drop("raw_text"), "labels")
    return index_scanned(numbered).select(F.col("index").alias("pos"), "label")


def _split_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines cut at every separator Python knows, not only at line feeds and returns."""
    scanned = scan_text(spark, path)
    pieces = F.explode(F.split("raw_text", EXTRA_LINE_BREAKS))
    return scanned.withColumn("raw_text", pieces)


def read_jsonl_labels(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    return _positions(record_labels(_split_lines(spark, path), "raw_text", key or DEFAULT_LABEL_KEY))


def read_text_labels(
    spark: SparkSession, path: str, key: str | None = None, default_key: str = DEFAULT_LABEL_KEY
) -> DataFrame:
    return _positions(loose_labels(_split_lines(spark, path), "raw_text", key, default_key))


def read_json_labels(
    spark: SparkSession, path: str, key: str | None = None, default_key: str = DEFAULT_LABEL_KEY
) -> DataFrame:
    """Labels of one JSON document.

    A document is one value, so one task parses it; long label lists belong
    in JSON lines. A document of another shape is read line by line instead.
    """
    whole = spark.read.text(path, wholetext=True)
    name = key or default_key
    shape = parse_records(whole, "value", literals=False).select(
        F.col("record").isNull().alias("broken"),
        has_label_shape(F.col("record"), name).alias("shaped"),
        (~kind(member(F.col("record"), name)).startswith("ARRAY")).alias("single"),
    )
    state = shape.first()
    if state is None or state["broken"]:
        raise ValueError(f"{path} is not a JSON document")
    if state["single"]:
        raise ValueError(f"{path} holds no list under {name!r}")
    if not state["shaped"]:
        return read_text_labels(spark, path, key, default_key)
    labels = document_labels(whole, "value", name)
    return labels.select(F.col("at").cast("long").alias("pos"), "label")


def read_labels(
    spark: SparkSession, path: str, key: str | None = None, default_key: str = DEFAULT_LABEL_KEY
) -> DataFrame:
    """Choose the reader by the file name, as ``.jsonl``, ``.json`` or anything else."""
    lower = path.lower().rstrip("/")
    if lower.endswith(".jsonl"):
        return read_jsonl_labels(spark, path, key or default_key)
    if lower.endswith(".json"):
        return read_json_labels(spark, path, key, default_key)
    return read_text_labels(spark, path, key, default_key)
