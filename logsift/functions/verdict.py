"""Prompts for a text generator and verdicts out of its free-text replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions.pyjson import add_parsed
from logsift.functions.text import strip

# The prompt wording. The batch text follows the last character.
PROMPT_HEAD = """Determine if there is an error in this group of logs.Respond ONLY with valid JSON in this exact format, do not include any extra text or explanations:
{
  "is_error": true or false,
  "error_description": "brief description of the error or null",
  "recommended_action": "what action to take or null"
}

Log entry: """


def prompt(batch_text: Column) -> Column:
    return F.concat(F.lit(PROMPT_HEAD), batch_text)


def without_echo(output: Column, prompt_text: Column) -> Column:
    """Drop as many leading characters as the prompt has, then strip."""
    return strip(F.substring(output, F.length(prompt_text) + 1, F.length(output)))


def json_object_text(text: Column) -> Column:
    """From the first opening to the last closing brace; empty if there is none."""
    return F.regexp_extract(text, "(?s)\\{.*\\}", 0)


def member(value: Column, key: str) -> Column:
    """A member of a variant object; null only if the key is absent."""
    quoted = key.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(value, f"$['{quoted}']", "variant")


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def text_of(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def truthy(value: Column) -> Column:
    """Python truth value of a variant: empty, zero and null are false, ``"false"`` is true."""
    shape = kind(value)
    return (
        F.when(value.isNull() | (shape == "VOID"), F.lit(False))
        .when(shape == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(shape == "STRING", text_of(value) != "")
        .when(shape.startswith("ARRAY"), text_of(value) != "[]")
        .when(shape.startswith("OBJECT"), shape != "OBJECT<>")
        .otherwise(F.coalesce(F.try_variant_get(value, "$", "double") != 0, F.lit(True)))
    )


def text_field(value: Column, key: str) -> Column:
    """A text member of the reply; other kinds are given in their JSON form."""
    return text_of(member(value, key))


def parse_verdicts(df: DataFrame, reply: str) -> DataFrame:
    """Add ``error_found``, ``error_description`` and ``recommended_action``.

    A reply without a JSON object, or with a broken one, means no error.
    """
    found = F.nullif(json_object_text(F.col(reply)), F.lit(""))
    parsed = add_parsed(df.withColumn("_object", found), "_object", "_reply", literals=False)
    return (
        parsed.withColumn("error_found", truthy(member(F.col("_reply"), "is_error")))
        .withColumn("error_description", text_field(F.col("_reply"), "error_description"))
        .withColumn("recommended_action", text_field(F.col("_reply"), "recommended_action"))
        .drop("_object", "_reply")
    )
