"""Replies, truth values, classifiers and error isolation."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from logsift.functions.verdict import parse_verdicts, prompt, without_echo
from logsift.operators.classify import (
    generate_replies,
    packed,
    classify_batches,
    generative_classifier,
    python_classifier,
    rule_classifier,
)
from logsift.operators.batching import summary

REPLIES = [
    '{"is_error": true, "error_description": "database connection error", "recommended_action": "restart service"}',
    'text before {"is_error": false} and after',
    '{\n "is_error": true\n}',
    "no object", "", "{", "}{", "{}", '{"is_error": "false"}', '{"is_error": 0}', '{"is_error": 0.0}', '{"is_error": -0.0}',
    '{"is_error": null}', '{"is_error": []}', '{"is_error": [null]}', '{"is_error": {}}', '{"is_error": {"a": 1}}',
    '{"is_error": ""}', '{"is_error": " "}', '{"is_error": NaN}', '{"is_error": -Infinity}', '{"is_error": 1e400}',
    '{"is_error": true, "is_error": false}', '{"is_error": false, "is_error": 2}', '{"is_error": true} {"is_error": false}',
    '{"is_error": 100000000000000000000000000000000000000000000}', '{"is_error": tru}', "{'is_error': True}",
]


def python_verdict(reply: str) -> bool:
    match = re.search(r"\{.*\}", reply, re.DOTALL)
    try:
        return bool(json.loads(match.group()).get("is_error", False)) if match else False
    except json.JSONDecodeError:
        return False


def test_verdicts_follow_python(spark):
    df = spark.createDataFrame(list(enumerate(REPLIES)), "i long, reply string")
    rows = parse_verdicts(df, "reply").orderBy("i").collect()
    assert [r["error_found"] for r in rows] == [python_verdict(r) for r in REPLIES]
    assert (rows[0]["error_description"], rows[0]["recommended_action"]) == ("database connection error", "restart service")
    assert rows[1]["error_description"] is None


def test_prompt_and_echo(spark):
    df = spark.createDataFrame([("line\n[2] x",)], "t string").withColumn("p", prompt(F.col("t")))
    row = df.select("p", without_echo(F.concat("p", F.lit(" \n{} \t")), F.col("p")).alias("reply")).first()
    assert row["p"].startswith("Determine if there is an error in this group of logs.Respond ONLY")
    assert row["p"].endswith("\n}\n\nLog entry: line\n[2] x") and '"is_error": true or false,\n' in row["p"]
    assert row["reply"] == "{}"


def batches(spark, texts):
    rows = [(i + 7, [(i, "app.log", t)]) for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "batch_id long, entries array<struct<index:long, source_file:string, raw_text:string>>"
    )


def test_generator_reply_decides(spark):
    reply = REPLIES[0]
    classifier = generative_classifier(lambda: lambda text: text + "  " + reply, "demo-model", echoes_prompt=True)
    row = classify_batches(batches(spark, ["ERROR: database connection timed out"]), classifier).first()
    assert (row["batch_id"], row["error_found"], row["model_name"]) == (7, True, "demo-model")
    assert row["results"] == [] and row["error"] is None and row["elapsed_ms"] >= 0


def test_a_failing_batch_becomes_an_error_row(spark):
    def factory():
        def generate(text):
            if "bad" in text:
                raise RuntimeError("boom")
            return '{"is_error": false}'

        return generate

    for tasks in (None, 3):
        result = classify_batches(batches(spark, ["ok", "bad", "ok"]), generative_classifier(factory, "m", tasks=tasks))
        rows = sorted((r["batch_id"], r["error_found"], r["model_name"], r["error"]) for r in result.collect())
        assert rows == [(7, False, "m", None), (8, True, "m", "RuntimeError: boom"), (9, False, "m", None)]


def test_prompts_are_packed_by_length():
    lengths = [5, 900, 3, 5, 40, 0, 38, 200]
    groups = packed(lengths, 100)
    assert sorted(i for g in groups for i in g) == list(range(8))
    assert all(len(g) == 1 or max(lengths[i] for i in g) * len(g) <= 100 for g in groups)
    assert groups == [[5, 2, 0, 3], [6, 4], [7], [1]]
    assert packed([], 100) == []


def test_groups_keep_order_and_isolate_errors(spark):
    def factory():
        def generate(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("boom")
            if any("short" in t for t in texts):
                return []
            return [t.upper() for t in texts]

        return generate

    texts = [f"{'x' * (i * 7 % 13)}{'bad' if i % 10 == 4 else 'short' if i % 10 == 7 else i}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").coalesce(1)
    rows = generate_replies(df, "text", factory, group_chars=80).orderBy("i").collect()
    for i, (row, text) in enumerate(zip(rows, texts, strict=True)):
        error = {4: "RuntimeError: boom", 7: "ValueError: 0 replies to 1 prompts"}.get(i % 10)
        assert (row["text"], row["reply"], row["error"]) == (text, None if error else text.upper(), error)
        assert row["elapsed_ms"] >= 0


def test_a_failing_factory_becomes_error_rows(spark):
    def factory():
        raise OSError("no model")

    rows = classify_batches(batches(spark, ["a", "b"]), python_classifier(factory)).collect()
    assert [(r["error_found"], r["error"]) for r in rows] == [(True, "OSError: no model")] * 2


def test_rule_classifier_and_summary_shape(spark):
    rows = summary(classify_batches(batches(spark, ["fine", "FATAL"]), rule_classifier(None))).orderBy("batch_id").collect()
    assert [r.asDict() for r in rows] == [
        {"batch_id": 7, "error_found": False, "model_name": None, "embedder_model_name": None},
        {"batch_id": 8, "error_found": True, "model_name": None, "embedder_model_name": None},
    ]
