"""Batch classifiers: keyword rule, Python callable, text generator.

A classifier takes ``(batch_id, entries)`` and gives one row per batch with
:data:`RESULT`. User code is built once per Python worker by a factory and gets
whole Arrow batches; a batch that fails becomes an error row, never a failed
task.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.functions.verdict import parse_verdicts, prompt, without_echo
from logsift.operators.batching import batch_text, entry_verdicts, rule_verdicts
from logsift.schemas import LINE_RESULT

RESULT = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("error_found", T.BooleanType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("error_description", T.StringType()),
        T.StructField("recommended_action", T.StringType()),
        T.StructField("results", T.ArrayType(LINE_RESULT)),
        T.StructField("error", T.StringType()),
        T.StructField("elapsed_ms", T.DoubleType()),
    ]
)

_ARROW_LINE = pa.struct(
    [
        ("log_index", pa.int64()),
        ("is_error", pa.bool_()),
        ("error_description", pa.string()),
        ("recommended_action", pa.string()),
    ]
)
_ARROW_RESULT = pa.schema(
    [
        ("batch_id", pa.int64()),
        ("error_found", pa.bool_()),
        ("model_name", pa.string()),
        ("error_description", pa.string()),
        ("recommended_action", pa.string()),
        ("results", pa.list_(_ARROW_LINE)),
        ("error", pa.string()),
        ("elapsed_ms", pa.float64()),
    ]
)

Classifier = Callable[[DataFrame], DataFrame]
RULE_MODEL = "keyword-rules"


def _shaped(df: DataFrame) -> DataFrame:
    """Put the columns of a partial result in order; absent ones are null."""
    columns = []
    for field in RESULT.fields:
        if field.name in df.columns:
            columns.append(F.col(field.name).cast(field.dataType).alias(field.name))
        elif field.name == "results":
            columns.append(F.array().cast(field.dataType).alias(field.name))
        else:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
    return df.select(*columns)


def rule_classifier(model_name: str | None = RULE_MODEL) -> Classifier:
    """A batch is an error if a line is; plain columns, no Python."""
    return lambda batches: _shaped(entry_verdicts(batches).withColumn("model_name", F.lit(model_name)))


def rule_results(batched: DataFrame, model_name: str | None = RULE_MODEL) -> DataFrame:
    """The same verdicts straight from lines with a ``batch_id``."""
    return _shaped(rule_verdicts(batched).withColumn("model_name", F.lit(model_name)))


def _timed(work: Callable[[dict], dict], row: dict) -> dict:
    """Run one batch; an exception turns into an ``error`` text."""
    start = time.perf_counter()
    try:
        result = dict(work(row))
        result["error"] = None
    except Exception as failure:  # noqa: BLE001 - user code may raise anything
        result = {"error": f"{type(failure).__name__}: {failure}"}
    result["elapsed_ms"] = (time.perf_counter() - start) * 1000.0
    return result


def python_classifier(
    factory: Callable[[], Callable[[int, list[dict]], bool | dict]], model_name: str | None = None
) -> Classifier:
    """``factory()`` gives ``analyze(batch_id, entries)``, which returns a flag or a dict.

    The dict may hold ``error_found``, ``error_description``,
    ``recommended_action`` and ``results`` (one dict per flagged line).
    """
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analyze = None

        def work(row: dict) -> dict:
            nonlocal analyze
            if analyze is None:
                analyze = factory()
            answer = analyze(row["batch_id"], row["entries"])
            return dict(answer) if isinstance(answer, dict) else {"error_found": bool(answer)}

        for frame in frames:
            rows = []
            for row in frame.to_pylist():
                result = _timed(work, row)
                if result["error"] is not None:
                    result["error_found"] = True
                lines = [{f: line.get(f) for f in LINE_RESULT.names} for line in result.get("results") or []]
                rows.append({**result, "results": lines, "batch_id": row["batch_id"], "model_name": model_name})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW_RESULT)

    return lambda batches: batches.select("batch_id", "entries").mapInArrow(run, RESULT)


def packed(lengths: list[int], budget: int) -> list[list[int]]:
    """Positions in groups of similar lengths, so that the longest times the number stays within ``budget``.

    A text beyond the budget is a group of its own. Texts of a group are padded to the longest, hence the order by length.
    """
    groups: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        if groups and lengths[i] * (len(groups[-1]) + 1) <= budget:
            groups[-1].append(i)
        else:
            groups.append([i])
    return groups


def _in_groups(generate: Callable[[list[str]], list[str]], texts: list[str], budget: int) -> list[dict]:
    """One result per text, in the order of ``texts``; the texts of a failing group are asked for one by one."""

    def ask(row: dict) -> dict:
        replies = list(generate(row["texts"]))
        if len(replies) != len(row["texts"]):
            raise ValueError(f"{len(replies)} replies to {len(row['texts'])} prompts")
        return {"replies": replies}

    done: list[dict] = [{}] * len(texts)
    for group in packed([len(t or "") for t in texts], budget):
        result = _timed(ask, {"texts": [texts[i] for i in group]})
        for place, i in enumerate(group):
            one = result if result["error"] is None or len(group) == 1 else _timed(ask, {"texts": [texts[i]]})
            reply = one["replies"][place if one is result else 0] if one["error"] is None else None
            shared = len(group) if one is result else 1
            done[i] = {"reply": reply, "error": one["error"], "elapsed_ms": one["elapsed_ms"] / shared}
    return done


def generate_replies(
    df: DataFrame,
    prompt_column: str,
    factory: Callable[[], Callable[[str], str]] | Callable[[], Callable[[list[str]], list[str]]],
    group_chars: int | None = None,
) -> DataFrame:
    """Add ``reply``, ``error`` and ``elapsed_ms`` from a text generator called per row.

    With ``group_chars`` it takes lists: prompts of similar length, whose longest times their number is at most that.
    """
    schema = T.StructType(
        [
            *df.schema.fields,
            T.StructField("reply", T.StringType()),
            T.StructField("error", T.StringType()),
            T.StructField("elapsed_ms", T.DoubleType()),
        ]
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = None

        def generate(asked):
            nonlocal made
            if made is None:
                made = factory()
            return made(asked)

        for frame in frames:
            if group_chars is None:
                done = [_timed(lambda row: {"reply": generate(row["text"])}, {"text": text}) for text in frame[prompt_column]]
            else:
                done = _in_groups(generate, frame[prompt_column].tolist(), group_chars)
            yield frame.assign(
                reply=[d.get("reply") for d in done],
                error=[d["error"] for d in done],
                elapsed_ms=[d["elapsed_ms"] for d in done],
            )

    return df.mapInPandas(run, schema)


def generative_classifier(
    factory: Callable[[], Callable[[str], str]] | Callable[[], Callable[[list[str]], list[str]]],
    model_name: str | None = None,
    echoes_prompt: bool = False,
    tasks: int | None = None,
    group_chars: int | None = None,
) -> Classifier:
    """Prompt, generate, parse.

    ``echoes_prompt`` is for generators that return the prompt before their
    reply. ``tasks`` spreads the batches over that many tasks first, for
    generators so slow that the extra shuffle is cheap. ``group_chars`` is for
    generators that take lists of prompts.
    """

    def classify(batches: DataFrame) -> DataFrame:
        prompts = batches.select("batch_id", prompt(batch_text(F.col("entries"))).alias("prompt"))
        if tasks:
            prompts = prompts.repartition(tasks)
        replies = generate_replies(prompts, "prompt", factory, group_chars)
        if echoes_prompt:
            replies = replies.withColumn("reply", without_echo(F.col("reply"), F.col("prompt")))
        failed = F.col("error").isNotNull()
        parsed = parse_verdicts(replies, "reply")
        return _shaped(
            parsed.withColumn("error_found", failed | F.col("error_found")).withColumn(
                "model_name", F.lit(model_name)
            )
        )

    return classify


def classify_batches(batches: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """Apply a classifier; the keyword rule if none is given."""
    return (classifier or rule_classifier())(batches)
