"""Scalar functions against Python's own string handling."""

from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logsift.functions import rules, text

# The mask patterns.
MASKS = [
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<IP>"),
    (r"\b[a-fA-F0-9]{8}(-[a-fA-F0-9]{4}){3}-[a-fA-F0-9]{12}\b", "<UUID>"),
    (r"\b\d+\b", "<NUM>"),
]


def python_template(value: str) -> str:
    for pattern, token in MASKS:
        value = re.sub(pattern, token, value)
    return value


def column(spark, values, expression):
    df = spark.createDataFrame(list(enumerate(values)), "i long, s string")
    return [r["x"] for r in df.select("i", expression(F.col("s")).alias("x")).orderBy("i").collect()]


EDGES = [
    "sshd[24200]: Failed password for root from 173.234.31.186 port 38926 ssh2",
    "10ms 1.5 _7 -3 1.2.3.4.5",
    "é12 ٣ x",
    "12́ 34 ²5 x² 6² ½7",
    "1234.1.1.1 1.1.1.1234 1.1.1.1a 255.255.255.255",
    "550e8400-e29b-41d4-a716-446655440000 x550e8400-e29b-41d4-a716-446655440000",
    "550e8400-e29b-41d4-a716-4466554400001",
    "12345678-1234-1234-1234-123456789012",
    "中1文 1中 2。3",
    "",
    "1",
]


def test_templates_of_edge_lines(spark):
    assert column(spark, EDGES, text.log_template) == [python_template(v) for v in EDGES]


def test_masks_of_random_lines(spark):
    alphabet = st.sampled_from(list("0123456789.-abF_ é٣²中́ ") + ["1.2.3.4", "550e8400-e29b-41d4-a716-446655440000"])

    @settings(max_examples=1, deadline=None, derandomize=True)
    @given(st.lists(st.lists(alphabet, max_size=14).map("".join), min_size=400, max_size=400))
    def check(values):
        assert column(spark, values, text.log_template) == [python_template(v) for v in values]

    check()


def test_masking_twice_changes_nothing_on_ascii(spark):
    once = column(spark, [v for v in EDGES if v.isascii()], text.log_template)
    assert column(spark, once, text.log_template) == once


def test_strip_and_chomp_follow_python(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    values = [f"{s}a{s}b{s}" for s in spaces] + ["​x​", "  ", "x\r\n", "x\n\r\n\n", "x\r\r", "\n"]
    assert column(spark, values, text.strip) == [v.strip() for v in values]
    assert column(spark, values, text.chomp) == [v.rstrip("\n").rstrip("\r") for v in values]


def test_base_name_and_empty(spark):
    assert column(spark, ["/a/b.log", "b.log"], text.base_name) == ["b.log", "b.log"]
    assert column(spark, ["", "x"], text.empty_to_null) == [None, "x"]
    assert (text.clamp_batch_size(0), text.clamp_batch_size(7)) == (1, 7)
    assert (text.clamp_poll_seconds(-1), text.clamp_poll_seconds(2)) == (0.0, 2.0)


def test_labels_of_edge_lines(spark):
    lines = [
        ("INFO request ERROR", "INFO", True, "GENERIC_SYSTEM_ERROR"),
        ("WARNING slow", "WARN", False, "NORMAL"),
        ("took 500 ms", "INFO", True, "HTTP_SERVICE_FAILURE"),
        ("took 500", "INFO", False, "NORMAL"),
        ('"GET / HTTP/1.1" 503 1', "INFO", True, "HTTP_SERVICE_FAILURE"),
        ('"GET / http/1.1" 503 1', "INFO", False, "NORMAL"),
        ("critical: read time out on mysql", "CRITICAL", True, "TIMEOUT_ERROR"),
        ("fatal DBus", "FATAL", True, "DATABASE_ERROR"),
        ("login failed for author", "INFO", True, "AUTHENTICATION_ERROR"),
        ("consumer refused", "INFO", True, "MESSAGING_KAFKA_ERROR"),
        ("exception: room", "INFO", True, "RESOURCE_EXHAUSTION"),
        ("failed to restart", "INFO", True, "HTTP_SERVICE_FAILURE"),
    ]
    df = spark.createDataFrame([(i, row[0]) for i, row in enumerate(lines)], "i long, raw_text string")
    got = rules.label_lines(df).orderBy("i").collect()
    assert [(r["raw_text"], r["level"], r["is_error"], r["error_category"]) for r in got] == lines
    assert all(r["severity"] == ("HIGH" if r["is_error"] else "NONE") for r in got)


def test_blank_lines_are_not_labelled(spark):
    df = spark.createDataFrame([("   ",), (" \t",), (" x ",)], "raw_text string")
    assert [r["raw_message"] for r in rules.label_lines(df).collect()] == ["x"]


def test_labelled_record_shape(spark):
    df = spark.createDataFrame([("ERROR 5",)], "raw_text string")
    record = rules.label_lines(df).select(rules.labelled_record("svc").alias("r")).first()["r"].asDict(True)
    assert record == {
        "service": {"name": "svc", "environment": "production"},
        "log_data": {"level": "ERROR", "template": "ERROR <NUM>", "raw_message": "ERROR 5"},
        "ground_truth_label": {
            "is_error": True, "error_category": "GENERIC_SYSTEM_ERROR", "severity": "HIGH",
        },
    }


def test_labelling_needs_no_shuffle_and_no_python(spark, sf):
    from suite.fixture import lines

    plan = rules.label_lines(lines(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
