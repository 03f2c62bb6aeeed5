"""Row shapes shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

ENTRY = T.StructType(
    [
        T.StructField("index", T.LongType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("raw_text", T.StringType()),
    ]
)

BATCH = T.StructType(
    [T.StructField("batch_id", T.LongType()), T.StructField("entries", T.ArrayType(ENTRY))]
)

LINE_RESULT = T.StructType(
    [
        T.StructField("log_index", T.LongType()),
        T.StructField("is_error", T.BooleanType()),
        T.StructField("error_description", T.StringType()),
        T.StructField("recommended_action", T.StringType()),
    ]
)

SUMMARY = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("error_found", T.BooleanType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("embedder_model_name", T.StringType()),
    ]
)

STORE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("raw_text", T.StringType()),
        T.StructField("is_error", T.BooleanType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("embedder_model_name", T.StringType()),
    ]
)

# Defaults and limits that decide results.
DEFAULT_BATCH_SIZE = 100
DEFAULT_POLL_SECONDS = 5.0
DEFAULT_REUSE_THRESHOLD = 0.8
DEFAULT_DIMENSION = 384
DEFAULT_LABEL_KEY = "error_found"
