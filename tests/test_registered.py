"""Every registered query against its SQL, and the sinks' files."""

from __future__ import annotations

import json

import pytest

import __spark_entry__ as entry
import suite.lines
import suite.scoring
import suite.streams
import suite.vectors
from logsift.functions.rules import label_lines
from logsift.sinks.results import append_json_array, append_summaries, existing_items, read_summaries, write_labelled_array
from suite.check import compare, connect
from suite.fixture import lines

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


NAMES = sorted(name for module in (suite.lines, suite.scoring, suite.vectors, suite.streams) for name in module.CASES)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, sf, duck, name):
    assert name in ORACLES
    outcome = compare(spark, duck, sf, entry.queries()[name], ORACLES[name])
    assert outcome.startswith("ok") and outcome != "ok 0", outcome


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def results(spark, first):
    return spark.createDataFrame([(first, True), (first + 1, False)], "batch_id long, error_found boolean")


def test_summaries_are_appended_with_all_keys(spark, tmp_path):
    path = str(tmp_path / "out")
    append_summaries(results(spark, 3), path)
    append_summaries(results(spark, 5), path)
    lines = [json.loads(x) for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()]
    assert {"batch_id": 3, "error_found": True, "model_name": None, "embedder_model_name": None} in lines
    assert len(lines) == 4 == read_summaries(spark, path).count()


def array_in(folder):
    return json.loads("".join(f.read_text() for f in sorted(folder.glob("part-*"))))


@pytest.mark.parametrize("before, kept", [("[]", []), ('[{"batch_id":9},1]', [{"batch_id": 9}, 1]), ("{}", []), ("[1] x", []), ("", [])])
def test_array_document_is_continued(spark, tmp_path, before, kept):
    (tmp_path / "old.json").write_text(before)
    append_json_array(results(spark, 0), str(tmp_path / "old.json"), str(tmp_path / "new"))
    document = array_in(tmp_path / "new")
    assert document[: len(kept)] == kept and [d["batch_id"] for d in document[len(kept) :]] == [0, 1]
    assert existing_items(spark, str(tmp_path / "old.json")).count() == len(kept)


@pytest.mark.parametrize("before, items", [('[{"a":1,"a":2},{"b":1}]', ['{"a":2}', '{"b":1}']), ('[{"a":NaN},"é"]', ['{"a":NaN}', '"é"'])])
def test_array_items_that_sparks_parser_refuses_are_kept(spark, tmp_path, before, items):
    (tmp_path / "old.json").write_text(before)
    assert [r["json"] for r in existing_items(spark, str(tmp_path / "old.json")).orderBy("at").collect()] == items


def test_large_array_is_kept(spark, tmp_path):
    (tmp_path / "old.json").write_text("[" + ",".join(['{"text": "' + "x" * 1_000_000 + '"}'] * 140) + "]")
    assert existing_items(spark, str(tmp_path / "old.json")).count() == 140


def test_labelled_records_as_an_array(spark, tmp_path, sf):
    labelled = label_lines(lines(spark, sf)).limit(50)
    write_labelled_array(labelled, ["line_no"], str(tmp_path / "array"))
    assert len(array_in(tmp_path / "array")) == 50
