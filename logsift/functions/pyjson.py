"""JSON parsing that accepts exactly what Python accepts.

Spark's parser stops after the first value and ignores what follows it, so the
text is parsed together with an end mark. Repeated keys, ``NaN``/``Infinity``
and Python literals (``{'a': True}``), which it refuses, are rewritten as plain
JSON. The function receives null for every row that Spark parsed itself, so
only the refused rows cost Python work.
"""

from __future__ import annotations

import ast
import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A finite stand-in: like NaN and Infinity it is a truthy number other than 1.
_NOT_FINITE = 2


_END = "logsift: end of text"


def _marked(text: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(f', "{_END}"]')))


def _unmarked(marked: Column) -> Column:
    ended = F.try_variant_get(marked, "$[1]", "string") == _END
    return F.when(ended, F.try_variant_get(marked, "$[0]", "variant"))


def whole_json(text: Column) -> Column:
    """The variant of a JSON text, null unless all of the text is one value."""
    return _unmarked(_marked(text))


def _plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, int):
        return value if abs(value) < 2**63 else float(value) if abs(value) < 10**308 else _NOT_FINITE
    if isinstance(value, float):
        return value if math.isfinite(value) else _NOT_FINITE
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items() if isinstance(k, str)}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [_plain(v) for v in value]
    if isinstance(value, (bytes, complex)) or value is Ellipsis:
        return ["?"] if value else []
    return [str(value)]


def _rewrite(text: str | None, literals: bool) -> str | None:
    if text is None:
        return None
    try:
        return json.dumps(_plain(json.loads(text)))
    except (json.JSONDecodeError, RecursionError):
        if not literals:
            return None
    try:
        return json.dumps(_plain(ast.literal_eval(text)))
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def _json_only(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _rewrite(t, literals=False))


@F.pandas_udf(T.StringType())
def _json_or_literal(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _rewrite(t, literals=True))


def repaired(text: Column, parsed: Column, literals: bool) -> Column:
    """JSON text for rows where ``parsed`` is null, else null."""
    udf = _json_or_literal if literals else _json_only
    return udf(F.when(parsed.isNull(), text))


def add_parsed(df: DataFrame, text: str, into: str, literals: bool) -> DataFrame:
    """Add the variant of a text column: Spark's parser first, the rewriting for the rest."""
    return (
        df.withColumn("_marked", _marked(F.col(text)))  # on its own, so it is parsed once
        .withColumn("_parsed", _unmarked(F.col("_marked")))
        .withColumn("_repaired", repaired(F.col(text), F.col("_parsed"), literals))
        .withColumn(into, F.coalesce("_parsed", F.try_parse_json("_repaired")))
        .drop("_marked", "_parsed", "_repaired")
    )
