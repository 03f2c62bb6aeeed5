"""Keyword rules: level, error flag, category and severity of a log line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions.text import is_blank, log_template, strip

# Keyword lists, category names and levels decide the labels.
ERROR_KEYWORDS = ["ERROR", "FATAL", "CRITICAL", "EXCEPTION", "FAILED", "TIMEOUT", "REFUSED"]
CATEGORY_KEYWORDS = [
    ("TIMEOUT_ERROR", ["TIMEOUT", "TIME OUT"]),
    ("DATABASE_ERROR", ["POSTGRES", "MYSQL", "DB", "SQL"]),
    ("AUTHENTICATION_ERROR", ["SSH", "PASSWORD", "AUTH"]),
    ("MESSAGING_KAFKA_ERROR", ["KAFKA", "BROKER", "CONSUMER"]),
    ("RESOURCE_EXHAUSTION", ["MEMORY", "OOM", "HEAP"]),
    ("HTTP_SERVICE_FAILURE", ["HTTP", "500", "REST"]),
]
OTHER_ERROR = "GENERIC_SYSTEM_ERROR"
NO_ERROR = "NORMAL"
LEVELS = ["INFO", "DEBUG", "WARN", "ERROR", "FATAL", "CRITICAL"]
DEFAULT_LEVEL = "INFO"
DEFAULT_SERVICE = "university-service"
ENVIRONMENT = "production"
HTTP_SERVER_ERROR = 'HTTP/[^\\n]{3}" 5\\p{Nd}{2}'
SERVER_ERROR_WORD = " 500 "


def _contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(word) for word in words])


def error_flag(raw: Column, upper: Column) -> Column:
    """Any error keyword in the upper-cased line, or an HTTP 5xx sign in the raw one."""
    return (
        _contains_any(upper, ERROR_KEYWORDS)
        | raw.contains(SERVER_ERROR_WORD)
        | raw.rlike(HTTP_SERVER_ERROR)
    )


def error_category(is_error: Column, upper: Column) -> Column:
    rule = F.when(~is_error, F.lit(NO_ERROR))
    for name, words in CATEGORY_KEYWORDS:
        rule = rule.when(_contains_any(upper, words), F.lit(name))
    return rule.otherwise(F.lit(OTHER_ERROR))


def log_level(upper: Column) -> Column:
    """The first level of the list that occurs anywhere, whatever its position.

    A line with WARNING also holds WARN, so WARN is the only warning level.
    """
    rule = F.when(upper.contains(LEVELS[0]), F.lit(LEVELS[0]))
    for level in LEVELS[1:]:
        rule = rule.when(upper.contains(level), F.lit(level))
    return rule.otherwise(F.lit(DEFAULT_LEVEL))


def severity(is_error: Column) -> Column:
    return F.when(is_error, F.lit("HIGH")).otherwise(F.lit("NONE"))


def label_lines(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Add level, template, message and ground-truth columns; blank lines go.

    One narrow stage. ``_upper`` is projected on its own so that every rule
    reads the same upper-cased value instead of computing it again.
    """
    raw = F.col(text)
    return (
        df.where(~is_blank(raw))
        .withColumn("_upper", F.upper(raw))
        .withColumn("is_error", error_flag(raw, F.col("_upper")))
        .withColumn("level", log_level(F.col("_upper")))
        .withColumn("error_category", error_category(F.col("is_error"), F.col("_upper")))
        .withColumn("severity", severity(F.col("is_error")))
        .withColumn("raw_message", strip(raw))
        .withColumn("template", log_template(F.col("raw_message")))
        .drop("_upper")
    )


def labelled_record(service_name: str = DEFAULT_SERVICE) -> Column:
    """The nested record over the columns that :func:`label_lines` adds."""
    return F.struct(
        F.struct(F.lit(service_name).alias("name"), F.lit(ENVIRONMENT).alias("environment")).alias("service"),
        F.struct("level", "template", "raw_message").alias("log_data"),
        F.struct("is_error", "error_category", "severity").alias("ground_truth_label"),
    )
