"""The registered queries against their SQL, and what the contracts ask of those without."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from logsift.llm import queries
from suite.check import compare, connect
from tests.llm import brute

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", [n for n, (_, sql) in queries.CASES.items() if sql])
def test_query_matches_its_sql(spark, name):
    outcome = compare(spark, connect(SF), SF, queries.CASES[name][0], queries.CASES[name][1])
    assert outcome.startswith("ok") and outcome != "ok 0", outcome


def test_all_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()


def test_base_rules_of_the_documents(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op2_outliers(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.base_counts(texts[r.doc_id])


def test_secrets_of_the_documents(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kinds = ["assign", "access", "hex"]
    for r in queries.op7_secrets(spark, sf).collect():
        want = [f"{kinds[k]}:{a}:{b}" for a, k, b in brute.base_spans(texts[r.doc_id])]
        assert [s for s in r.spans.split(",") if s.split(":")[0] in kinds] == want
