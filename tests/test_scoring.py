"""Label coercion, label files, pairing and metrics."""

from __future__ import annotations

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from logsift.functions.labels import coerce_labels
from logsift.operators import metrics
from logsift.operators.pairing import pair_by_position
from logsift.plans.evaluation import compare_files
from logsift.sinks.results import metrics_json
from logsift.sources.labelfiles import read_labels


def pairs(spark, true, pred):
    return spark.createDataFrame(list(zip(true, pred)), "y_true int, y_pred int")


def close(a, b):
    return (a is None and b is None) or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)


# ---- coercion ---------------------------------------------------------------


def test_string_labels(spark):
    values = ["true", " Yes ", "1.0", "2", "foo", None, "ERROR_FOUND", "Y\n", "OK", "", "1", "n"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    plain = [r["v"] for r in coerce_labels(df, "v").orderBy("i").collect()]
    assert plain == [1, 1, 0, 0, 0, 0, 1, 1, 0, 0, 1, 0]
    named = [r["v"] for r in coerce_labels(df, "v", positive_label="foo").orderBy("i").collect()]
    assert named == [1, 1, 0, 0, 1, 0, 1, 1, 0, 0, 1, 0]


def test_json_labels(spark):
    values = ["true", "false", "1", "1.0", "2", "0.5", "null", '"yes"', '"foo"', "[1]", '{"a":1}', "1e0", "1e400"]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string").withColumn("v", F.parse_json("v"))
    assert [r["v"] for r in coerce_labels(df, "v").orderBy("i").collect()] == [1, 0, 1, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0]


def test_typed_labels(spark):
    df = spark.createDataFrame([(True, 1, 1.0), (False, 2, 0.5), (None, None, None)], "a boolean, b int, c double")
    assert [tuple(r) for r in coerce_labels(df, "a", "b", "c").collect()] == [(1, 1, 1), (0, 0, 0), (0, 0, 0)]


# ---- metrics ----------------------------------------------------------------


def test_golden_binary_labels(spark):
    df = spark.createDataFrame([(False, False), (True, True), (True, False), (False, False)], "y_true boolean, y_pred boolean")
    row = metrics.evaluate(df).first()
    assert (row["accuracy"], row["f1_score"], row["confusion_matrix"]) == (0.75, 0.6666666666666666, [[2, 0], [1, 1]])
    assert (row["balanced_accuracy"], row["zero_one_loss"], row["hamming_loss"]) == (0.75, 0.25, 0.25)
    assert row["support"].asDict() == {"negative": 2, "positive": 2} and row["total_samples"] == 4
    assert math.isclose(row["matthews_corrcoef"], 1 / math.sqrt(3))


def by_hand(true, pred, zd):
    """The definitions, from the label lists."""
    def score(c):
        hit = sum(t == c == p for t, p in zip(true, pred))
        n_true, n_pred = true.count(c), pred.count(c)
        ratio = lambda a, b: a / b if b else zd
        return [ratio(hit, n_pred), ratio(hit, n_true), ratio(2 * hit, n_true + n_pred)], n_true

    present = sorted(set(true) | set(pred))
    scores = {c: score(c) for c in (0, 1)}
    agree = sum(t == p for t, p in zip(true, pred)) / len(true)
    columns = lambda: range(3)
    return {
        "binary": scores[1][0],
        "micro": [agree] * 3,
        "macro": [sum(scores[c][0][k] for c in present) / len(present) for k in columns()],
        "weighted": [sum(scores[c][0][k] * scores[c][1] for c in present) / len(true) for k in columns()],
    }


@pytest.mark.parametrize("zd", [0.0, 1.0])
def test_averages_on_all_small_cases(spark, zd):
    cases = [(t, p) for n in (1, 3) for t in itertools.product((0, 1), repeat=n) for p in itertools.product((0, 1), repeat=n)]
    for true, pred in random.Random(3).sample(cases, 14):
        got = {r["average"]: [r[m] for m in metrics.MEASURES] for r in metrics.metrics_averaged(pairs(spark, true, pred), zero_division=zd).collect()}
        want = by_hand(list(true), list(pred), zd)
        assert all(close(a, b) for k in want for a, b in zip(got[k], want[k])), (true, pred, got, want)


def test_zero_division_nan_leaves_the_class_out(spark):
    rows = metrics.metrics_averaged(pairs(spark, [1, 0], [0, 0]), ["binary", "macro"], zero_division=float("nan")).collect()
    assert [r["precision"] for r in rows] == [None, 0.5]


def test_given_labels_count_even_if_absent(spark):
    only_negative = pairs(spark, [0, 0], [0, 0])
    rows = metrics.metrics_averaged(only_negative, ["macro"], labels=[0, 1]).collect()
    assert rows[0]["recall"] == 0.5
    assert metrics.metrics_averaged(only_negative, ["macro"]).first()["recall"] == 1.0
    assert metrics.evaluate(only_negative).first()["balanced_accuracy"] == 1.0
    assert metrics.evaluate(only_negative).first()["matthews_corrcoef"] == 0.0


def test_wrong_options(spark):
    with pytest.raises(ValueError):
        metrics.averaged("precision", "samples")
    with pytest.raises(ValueError):
        metrics.averaged("precision", "binary", pos_label=2)
    with pytest.raises(Exception, match="At least one label"):
        metrics.confusion_matrix(pairs(spark, [0], [1]), [1]).collect()


def test_no_rows_give_null_ratios(spark):
    row = metrics.evaluate(pairs(spark, [], [])).first()
    assert row["accuracy"] is None and row["total_samples"] == 0


def test_large_counts_do_not_overflow(spark):
    counts = spark.createDataFrame([(4 * 10**17, 10**17, 10**17, 4 * 10**17)], "tn long, fp long, fn long, tp long")
    assert math.isclose(counts.select(metrics.matthews_corrcoef()).first()[0], 0.6)


def test_one_job_one_shuffle(spark):
    plan = metrics.evaluate(pairs(spark, [0, 1], [1, 1]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan


def test_report_as_json(spark):
    report = json.loads(metrics_json(metrics.evaluate(pairs(spark, [0, 1, 1], [0, 1, 0]))).first()["report"])
    assert report["confusion_matrix"] == [[1, 0], [1, 1]] and report["support"] == {"negative": 1, "positive": 2}
    labels = [row["label"] for row in report["classification_report"]]
    assert labels == ["0", "1", "accuracy", "macro avg", "weighted avg"] and len(report) == 16


# ---- files ------------------------------------------------------------------


def labels_of(spark, path, key=None):
    rows = read_labels(spark, str(path), key).orderBy("pos").select("pos", F.to_json("label").alias("label")).collect()
    assert [r["pos"] for r in rows] == list(range(len(rows)))
    return [None if r["label"] is None else json.loads(r["label"]) for r in rows]


def test_python_literal_file_against_itself(spark, tmp_path):
    path = tmp_path / "sample.jsonl"
    rows = [{"batch_id": i + 1, "error_found": flag} for i, flag in enumerate([False, True, True, False])]
    path.write_text("".join(f"{row}\n" for row in rows))
    for other in (None, str(path)):
        row = compare_files(spark, str(path), other).first()
        assert (row["accuracy"], row["f1_score"], row["confusion_matrix"]) == (1.0, 1.0, [[2, 0], [0, 2]])


def test_jsonl_reader(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    lines = ['{"error_found": true}', "", "  ", "[1]", "junk", '{"a": 1}', "{'error_found': None}", '{"error_found": 1} x',
             '{"error_found": 1, "error_found": 0}', '{"error_found": "a"}\x0b{"error_found": "b"}\x85{"error_found": "c"}', "7"]
    path.write_text("\n".join(lines), encoding="utf-8")
    assert labels_of(spark, path) == [True, None, None, 0, "a", "b", "c"]
    assert labels_of(spark, path, "a") == [None, 1, None, None, None, None, None]


def test_text_reader(spark, tmp_path):
    path = tmp_path / "labels.txt"
    path.write_text("true\n\n0\n'yes'\n{\"k\": null, \"error_found\": 1}\n{'error_found': 'no'}\nnot parsable\n[1]\nNaN\n")
    assert labels_of(spark, path, "k")[:6] == [True, 0, "yes", None, "no", [1]]
    assert len(labels_of(spark, path)) == 7


@pytest.mark.parametrize(
    "payload, key, want",
    [
        ({"error_found": [1, "a", None]}, None, [1, "a", None]),
        ({"results": [{"error_found": True}, {"x": 1}, 5]}, None, [True, None, 5]),
        ({"results": [1], "k": [2, 3]}, "k", [2, 3]),
        ([{"error_found": 0}, {"y": 1}], None, [0, None]),
        ([1, {"error_found": 0}, None], None, [1, {"error_found": 0}, None]),
        ([], None, []),
        ({"other": 1, "error_found_": 2}, None, [None]),
        (True, None, [True]),
    ],
)
def test_document_reader(spark, tmp_path, payload, key, want):
    path = tmp_path / "x.JSON"
    path.write_text(json.dumps(payload))
    assert labels_of(spark, path, key) == want


def test_document_that_is_not_json(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text("{'a': 1}")
    with pytest.raises(ValueError):
        read_labels(spark, str(path))


def test_lists_of_different_length(spark, tmp_path):
    long, short = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    long.write_text('{"error_found": 1}\n' * 3)
    short.write_text('{"error_found": 1}\n' * 2)
    with pytest.raises(Exception, match="differ in length, first unpaired position: 2"):
        compare_files(spark, str(long), str(short)).select("recall").collect()


def test_self_comparison_needs_no_join(spark):
    labels = spark.createDataFrame([(0, True), (1, False)], "pos long, label boolean")
    plan = metrics.evaluate(pair_by_position(labels))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_metrics_ignore_row_order(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 1), rng.randint(0, 1)) for _ in range(200)]
    first = metrics.evaluate(spark.createDataFrame(rows, "y_true int, y_pred int")).first()
    rng.shuffle(rows)
    assert metrics.evaluate(spark.createDataFrame(rows, "y_true int, y_pred int")).first() == first
