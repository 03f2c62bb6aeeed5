"""Links tool calls to their results, orders and validates them, and writes canonical JSON.

Calls and results are hash-joined by conversation and call identifier, after each
side is reduced to one row per identifier: the earliest call and the earliest result
count, and the numbers of repeats are kept. A call may name another call whose result it uses (``after``). Its
level is the length of that chain, found by pointer doubling in as many joins as the longest chain has binary
digits; calls on a cycle, or behind one, have no level. ``(level, turn, call_id)`` orders
a conversation topologically without gathering it in one task. Arguments are checked against
the tool's schema, a subset of JSON Schema.

Canonical JSON has keys in code point order, no white space, numbers without
needless fractions, and other characters than quotes, backslashes and controls as they are.

Cases: rows without a conversation or call identifier are left out. A call without result, a result without call, an unknown tool,
arguments that are null, no JSON object, hold a repeated key or nest deeper than 200 levels are reported in ``status`` and ``errors``; ``after`` naming no call
counts as no dependency and is null in the result. Words of a schema that are not checked are reported with each call of the tool. Columns beyond those named are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.staging import scratch_path, stage, stage_at, temporary_stages

KEY = ["conv_id", "call_id"]
# Arguments nested deeper are reported, not read on: parsing and writing JSON recurse.
MOST_DEPTH = 200
_TYPES = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}
# What of JSON Schema is checked; other words are reported, but for those that only describe.
_CHECKED = {"type", "enum", "const", "minimum", "maximum", "minLength", "maxLength", "pattern", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "anyOf"}
_DESCRIBES = {"title", "description", "default", "examples", "$schema", "$id", "$comment", "format"}


def canonical(value) -> str:
    """Canonical JSON of a parsed value, which is nested at most ``MOST_DEPTH`` deep."""
    text = json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    try:
        text.encode()
    except UnicodeEncodeError:  # half of a surrogate pair, which only an escape can hold
        return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), allow_nan=False)
    return text


def _plain(value):
    if isinstance(value, float) and math.isfinite(value) and value == int(value) and abs(value) < 2**53:
        return int(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def _pairs(pairs: list) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("repeated key")
    return found


def _no_constant(name: str):
    raise ValueError(f"{name} is no number")


def _finite(number: str) -> float:
    if math.isinf(value := float(number)):
        raise ValueError(f"{number} is too large")
    return value


def depth(text: str) -> int:
    """How deep brackets nest outside of strings, without recursion."""
    now = most = 0
    for mark in _MARKS.findall(text):
        if mark in "[{":
            now += 1
            most = max(most, now)
        elif mark in "]}":
            now -= 1
    return most


_MARKS = re.compile(r'"(?:[^"\\]|\\.)*+"?|[\[\]{}]', re.S)


def parse(text: str | None):
    """A JSON value; ValueError if it is none, ambiguous or too deep."""
    if text is None:
        raise ValueError("no arguments")
    if depth(text) > MOST_DEPTH:
        raise ValueError("nested too deep")
    return json.loads(text, object_pairs_hook=_pairs, parse_constant=_no_constant, parse_float=_finite)


def _number(value) -> bool:
    return isinstance(value, int | float) and not isinstance(value, bool)


def _is(value, kind: str) -> bool:
    if kind in ("number", "integer"):
        return _number(value) and (kind == "number" or value == int(value))
    return isinstance(value, _TYPES[kind])


def _same(one, other) -> bool:
    """Equal as JSON: true is not 1, but 1.0 is."""
    if isinstance(one, dict) and isinstance(other, dict):
        return one.keys() == other.keys() and all(_same(one[k], other[k]) for k in one)
    if isinstance(one, list) and isinstance(other, list):
        return len(one) == len(other) and all(map(_same, one, other))
    return one == other and isinstance(one, bool) == isinstance(other, bool)


def unchecked(schema, path: str = "$") -> list[str]:
    """Words and types of a schema that ``problems`` does not know; a schema is data of the caller, of few levels."""
    if isinstance(schema, bool):
        return []
    kinds = schema.get("type", [])
    found = [f"{path}: unknown type {k}" for k in ([kinds] if isinstance(kinds, str) else kinds) if k not in _TYPES and k not in ("number", "integer")]
    found += [f"{path}: unknown schema word {k}" for k in sorted(schema.keys() - _CHECKED - _DESCRIBES)]
    for k, part in schema.get("properties", {}).items():
        found += unchecked(part, f"{path}.{k}")
    for part in (schema.get(k) for k in ("items", "additionalProperties")):
        found += unchecked(part, f"{path}[]") if part is not None else []
    return found + [p for part in schema.get("anyOf", []) for p in unchecked(part, path)]


def problems(value, schema, path: str = "$") -> list[str]:
    """What of the schema is not met; a type may be a list of types. ``unchecked`` tells what is not looked at."""
    if isinstance(schema, bool):
        return [] if schema else [f"{path}: not allowed"]
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds if k in _TYPES or k in ("number", "integer")):
        return [f"{path}: not of type {' or '.join(kinds)}"]
    found, number = [], _number(value)
    if "enum" in schema and not any(_same(value, v) for v in schema["enum"]):
        found.append(f"{path}: not one of the allowed values")
    if "const" in schema and not _same(value, schema["const"]):
        found.append(f"{path}: not the given value")
    if number and value < schema.get("minimum", value):
        found.append(f"{path}: below {schema['minimum']}")
    if number and value > schema.get("maximum", value):
        found.append(f"{path}: above {schema['maximum']}")
    for kind, name in ((str, "Length"), (list, "Items")):
        if isinstance(value, kind) and len(value) < schema.get(f"min{name}", 0):
            found.append(f"{path}: too short")
        if isinstance(value, kind) and len(value) > schema.get(f"max{name}", len(value)):
            found.append(f"{path}: too long")
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        found.append(f"{path}: does not match")
    if "anyOf" in schema and all(problems(value, part, path) for part in schema["anyOf"]):
        found.append(f"{path}: fits none of the alternatives")
    if isinstance(value, dict):
        known, others = schema.get("properties", {}), schema.get("additionalProperties", True)
        found += [f"{path}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            found += problems(value[k], known.get(k, others), f"{path}.{k}")
    if isinstance(value, list) and "items" in schema:
        found += [p for i, v in enumerate(value) for p in problems(v, schema["items"], f"{path}[{i}]")]
    return found


def levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level``; null on a cycle or behind one. ``calls`` has one row per key and a valid or null ``after``."""
    spark = calls.sparkSession
    out = scratch_path(spark, "levels")
    with temporary_stages(spark):
        now = stage(calls.select(*KEY, F.col("after").alias("up"), F.when(F.col("after").isNull(), 0).otherwise(1).cast("long").alias("level")), "levels")
        waiting = now.filter("up IS NOT NULL").count()
        # Each round doubles the part of the chain that is known.
        longest, reach = now.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0, 1
        while waiting and reach <= longest:
            ahead = now.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
            joined = now.join(ahead, ["conv_id", "up"], "left").select(*KEY, F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"))
            now, reach = stage(joined, "levels"), reach * 2
            waiting = now.filter("up IS NOT NULL").count()
        return stage_at(now.select(*KEY, F.when(F.col("up").isNull(), F.col("level")).alias("level")), out)


def _checked(rows: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    blind = {name: [f"schema {p}" for p in unchecked(schema)] for name, schema in schemas.items()}

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            errors, lines = [], []
            for r in batch.itertuples(index=False):
                found, arguments = [], None
                if r.name is not None or r.arguments is not None:
                    try:
                        arguments = parse(r.arguments)
                        if not isinstance(arguments, dict):
                            found, arguments = ["arguments: no object"], None
                    except ValueError as failure:
                        known = str(failure) in ("repeated key", "nested too deep")
                        found = [f"arguments: {failure if known else 'not valid JSON'}"]
                    if r.name not in schemas:
                        found.append("name: unknown tool")
                    elif arguments is not None:
                        found += problems(arguments, schemas[r.name]) + blind[r.name]
                errors.append(found)
                lines.append(canonical({"call_id": r.call_id, "name": r.name, "arguments": arguments, "result": r.content}))
            yield batch.drop(columns=["arguments", "content"]).assign(errors=errors, json=lines)

    kind = "conv_id long, call_id string, turn long, name string, level long, after string, status string, n_calls long, n_results long, errors array<string>, json string"
    return rows.mapInPandas(check, kind)


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call identifier of either side.

    ``calls``: conv_id, call_id, turn, name, arguments, after. ``results``: conv_id, call_id, turn, content. ``schemas``: by tool name.
    """
    spark = calls.sparkSession
    first = F.min_by(F.struct("turn", "name", "arguments", "after"), F.struct("turn", "name", "arguments", "after")).alias("call")
    answer = F.min_by(F.struct("turn", "content"), F.struct("turn", "content")).alias("answer")
    known = calls.filter("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy(*KEY).agg(first, F.count("*").alias("n_calls"))
    known = stage(known.select(*KEY, "call.*", "n_calls"), "calls")
    answers = results.filter("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy(*KEY).agg(answer, F.count("*").alias("n_results"))
    answers = answers.select(*KEY, F.col("answer.turn").alias("result_turn"), F.col("answer.content").alias("content"), "n_results")
    named = known.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("there"))
    parents = known.select(*KEY, "after").join(named, ["conv_id", "after"], "left").withColumn("after", F.when(F.col("there"), F.col("after")))
    parents = stage(parents.select(*KEY, "after"), "parents")
    both = known.drop("after").join(parents, KEY).join(levels(parents), KEY).join(answers.hint("shuffle_hash"), KEY, "full")
    status = (
        F.when(F.col("n_calls").isNull(), "result without call")
        .when(F.col("n_results").isNull(), "call without result")
        .when(F.col("level").isNull(), "cycle")
        .when(F.col("result_turn") < F.col("turn"), "result before call")
        .otherwise("linked")
    )
    rows = both.select(
        F.col("conv_id").cast("long"), F.col("call_id").cast("string"), F.coalesce("turn", "result_turn").cast("long").alias("turn"), "name",
        "level", F.col("after").cast("string"), status.alias("status"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"), "arguments", "content",
    )
    return _checked(rows, schemas)
