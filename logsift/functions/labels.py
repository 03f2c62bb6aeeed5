"""Any kind of label value to 0 or 1."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.functions.text import strip
from logsift.functions.verdict import kind, text_of

# Label words.
POSITIVE_WORDS = ["1", "true", "yes", "y", "error", "error_found", "positive"]
NEGATIVE_WORDS = ["0", "false", "no", "n", "ok", "normal", "negative"]


def _from_words(text: Column, positive_label: Any) -> Column:
    word = F.lower(strip(text))
    other = (text == F.lit(positive_label)).cast("int") if isinstance(positive_label, str) else F.lit(0)
    return F.when(word.isin(POSITIVE_WORDS), 1).when(word.isin(NEGATIVE_WORDS), 0).otherwise(other)


def binary_label(value: Column, dtype: T.DataType, positive_label: Any = True) -> Column:
    """0 or 1 for a boolean, numeric, string or variant column; null counts as 0.

    ``positive_label`` decides only strings outside both word lists.
    """
    if isinstance(dtype, T.BooleanType):
        label = value.cast("int")
    elif isinstance(dtype, T.NumericType):
        label = (value.cast("double") == 1.0).cast("int")
    elif isinstance(dtype, T.StringType):
        label = F.when(value.isNull(), 0).otherwise(_from_words(value, positive_label))
    elif isinstance(dtype, T.VariantType):
        shape = kind(value)
        label = (
            F.when(shape == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("int"))
            .when(shape == "STRING", _from_words(text_of(value), positive_label))
            .when(
                (shape == "VOID") | shape.startswith("ARRAY") | shape.startswith("OBJECT"),
                F.lit(0),
            )
            .otherwise((F.try_variant_get(value, "$", "double") == 1.0).cast("int"))
        )
    else:
        label = F.lit(0)
    return F.coalesce(label, F.lit(0))


def coerce_labels(df: DataFrame, *columns: str, positive_label: Any = True) -> DataFrame:
    """Replace each named column by its 0/1 form."""
    types = {field.name: field.dataType for field in df.schema.fields}
    return df.withColumns({c: binary_label(F.col(c), types[c], positive_label) for c in columns})
