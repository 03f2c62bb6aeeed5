"""Trained operators on held-out rows, and the search behind them against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsift.llm import langid, queries, toxicity

SMALL = langid.Settings(documents_per_language=60, windows_per_document=2, steps=60, batch=64)


def test_gradient_is_the_slope_of_the_loss():
    net = langid.Network(["a", "b", "c"], 4, 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, label = rng.integers(1, 255, (7, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    mask = np.ones(x.shape)

    def loss():
        prob = net.byte_probabilities(x)
        return -np.log(prob[:, label, np.arange(5)]).mean()

    grad = net.gradient(x, mask, label)
    for name, t in ((n, t) for n in net.p for t in range(3)):
        cell = (t % net.p[name].shape[0], int(x[t % 7, t]) % net.p[name].shape[1])
        keep = net.p[name][cell]
        net.p[name][cell] = keep + 1e-3
        up = loss()
        net.p[name][cell] = keep - 1e-3
        down = loss()
        net.p[name][cell] = keep
        assert (up - down) / 2e-3 == pytest.approx(grad[name][cell], abs=2e-4)


def test_languages_of_edge_cases(spark):
    rows = [(i, f"the quick {w} fox and the dog", "en") for i, w in enumerate(["red", "big", "old", "fat"] * 5)]
    rows += [(100 + i, f"der {w} hund und die katze", "de") for i, w in enumerate(["rote", "große", "alte", "dicke"] * 5)]
    rows += [(200, None, "en"), (201, "", None), (202, "12 34 !?", "de"), (203, "ß" * 300_000, "de"), (None, "und die der", None), (0, rows[0][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    net = langid.fit(docs, SMALL)
    got = langid.identify(docs, net, SMALL).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (200, 201, 202):
            assert (r.lang_pred, r.score) == (langid.UNKNOWN, 0)
        else:
            assert r.lang_pred in ("de", "en") and 0 <= r.score <= 1
    assert sum(r.lang_pred == r.lang for r in got if r.doc_id is not None and r.doc_id < 120) >= 40
    assert langid.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {langid.UNKNOWN}


def test_batches_do_not_change_a_label():
    net = langid.Network(["a", "b"], 4, 1)
    texts = ["abc" * n for n in (1, 50, 700, 3)]
    whole = langid.label_texts(net, texts, SMALL)
    for i, t in enumerate(texts):
        assert langid.label_texts(net, [t], SMALL)[0] == pytest.approx(whole[i], rel=1e-4)


def test_held_out_languages(spark):
    got = queries.op10_langid(spark, "/root/testdata/sf0.01").filter("held_out")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    assert got.join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_held_out_toxicity(spark):
    got = queries.op9_toxicity(spark, "/root/testdata/sf0.1").filter("held_out")
    truth = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    rows = got.join(truth, "doc_id").select("score", "predicted", "toxic").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.97
    toxic = [r for r in rows if r.toxic]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.85
    # Calibrated: the mean score is near the share of toxic rows.
    assert abs(sum(r.score for r in rows) / len(rows) - len(toxic) / len(rows)) < 0.05


@pytest.mark.parametrize("block", [1, 4, 32])
def test_search_is_exact(block):
    rng = np.random.default_rng(block)
    examples = [(i, int(rng.random() < 0.3), {int(t): int(rng.integers(1, 4)) for t in rng.integers(0, 30, rng.integers(0, 6))}) for i in range(300)]
    settings = toxicity.Settings(block=block, nearest=7)
    index = toxicity.build_index(examples, rng.random(30) + 0.5, {0: 1.0, 1: 1.0}, settings)
    for _, _, counts in examples[:60]:
        query = tuple(sorted(counts.items()))
        want = []
        for i, entry in enumerate(index.entries):
            a, b = dict(index.vector(query)), dict(index.vector(entry))
            cosine = sum(a[t] * b.get(t, 0) for t in a)
            if cosine > 0:
                want.append((-round(cosine, 6), i))
        got = index.search(query)
        assert [c for c, _ in got] == pytest.approx([-c for c, _ in sorted(want)[:7]], abs=1e-5)


@pytest.mark.parametrize("width", [1, 3, 8])
def test_block_maxima_skip_blocks_and_no_hit(width):
    # Topics, as in a corpus: entries of one topic share its terms and stand together, all share ten frequent ones.
    rng = np.random.default_rng(width)
    examples = []
    for i in range(900):
        topic = i // 45
        own = {20 * topic + int(t): int(rng.integers(1, 4)) for t in rng.integers(0, 20, 12)}
        examples.append((i, int(topic % 3 == 0), {**{400 + int(t): 1 for t in rng.integers(0, 10, 4)}, **own}))
    weights = np.append(np.full(400, 2.0), np.full(10, 0.3))
    # Every list is long: block maxima decide alone.
    toxicity_long, toxicity.LONG = toxicity.LONG, 1e9
    try:
        index = toxicity.build_index(examples, weights, {0: 1.0, 1: 1.0}, toxicity.Settings(nearest=5, entries_of_block=width))
    finally:
        toxicity.LONG = toxicity_long
    dense = np.zeros((len(index.entries), 410))
    for i, e in enumerate(index.entries):
        dense[i, e[:, 0]] = index.cells(e)[1]
    queries = index.entries[::7]
    for query, near in zip(queries, index.search_all(queries), strict=True):
        cosines = (dense @ np.bincount(query[:, 0], index.cells(query)[1], minlength=410)).round(9)
        want = sorted((-c, i) for i, c in enumerate(cosines) if c > 0)[:5]
        assert [i for _, i in near] == [i for _, i in want]
    assert index.skipped / index.blocks > 0.5


def test_votes_never_see_their_example():
    # Each example has a term of its own and one of chance: with its own label in sight, votes would be right.
    rng = np.random.default_rng(5)
    examples = [(i, int(rng.random() < 0.5), toxicity._key({0: 1, 1 + i: 5})) for i in range(400)]
    votes, label, _ = toxicity.votes_by_fold(examples, np.ones(401), "linear", {0: 1.0, 1: 1.0}, toxicity.Settings())
    assert len(votes) == 400 and 0.35 < ((votes >= 0.5) == label).mean() < 0.65


def test_form_of_the_weights_is_chosen_inside_the_examples():
    # One term of many tells the classes apart, so that forms that follow the association lose less.
    rng = np.random.default_rng(6)
    examples = [(i, i % 2, toxicity._key({**{2 + int(t): 1 for t in rng.integers(0, 60, 15)}, i % 2: 1})) for i in range(300)]
    share, settings = {0: 1.0, 1: 1.0}, toxicity.Settings()
    losses = {f: toxicity.loss(*toxicity.votes_by_fold(examples, np.ones(62), f, share, settings)) for f in toxicity.FORMS}
    assert toxicity.chosen_form(examples, np.ones(62), share, settings) == min(losses, key=losses.get) != "none"


def test_isotonic():
    x, y = toxicity.isotonic(np.array([3.0, 1, 2, 2]), np.array([1.0, 0.5, 0, 1]), np.ones(4))
    assert list(x) == [1, 3] and list(y) == [0.5, 1]


def test_toxicity_of_edge_cases(spark):
    rows = [(i, ("vile " if i % 2 else "nice ") + f"word{i} text", None) for i in range(1, 60)] + [(100, None, None), (101, "", None), (None, "vile", None), (1, "vile text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)] + [(None, 1), (2, None), (5, 0)], "doc_id long, toxic int")
    index, vocabulary = toxicity.fit(docs, docs, labels)
    got = toxicity.score(docs, index, vocabulary).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 60)
    assert toxicity.fit(docs, docs, labels.limit(0)) == (None, {})
    assert {r.score for r in toxicity.score(docs, None, {}).collect()} == {0.0}


def test_every_term_of_the_examples_counts(spark):
    # No term below is associated with the label, and each rare one stands in a single example.
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 23}" for j in range(9)) + f" rare{i}a rare{i}b", i % 2) for i in range(40)]
    copies = [(1000 + i, t) for i, t, _ in rows] + [(2000, "rare7a only"), (2001, "nothing known")]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + copies, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    index, vocabulary = toxicity.fit(docs, docs, labels)
    assert set(vocabulary) == {w for _, t, _ in rows for w in t.split()}
    got = {r.doc_id: r for r in toxicity.score(docs, index, vocabulary).collect()}
    assert all(got[1000 + i].evidence[0] == i for i, _, _ in rows) and all(not r.terms for r in got.values())
    assert got[2000].evidence == [7] and got[2001].evidence == []


def test_sample_ranks_few_rows(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'t' AS text")
    labels = spark.range(3000).selectExpr("id AS doc_id", "CAST(id % 10 = 0 AS int) AS toxic")
    want = labels.withColumn("draw", F.xxhash64("doc_id", F.lit(3))).toPandas().sort_values(["draw", "doc_id"])
    for bound in (40, 2900):
        sample, share = toxicity._sample(docs, labels, toxicity.Settings(examples_per_class=bound))
        got = sample.toPandas()
        for label, size in ((0, 2700), (1, 300)):
            assert set(got[got["label"] == label]["doc_id"]) == set(want[want["toxic"] == label]["doc_id"].head(bound))
            assert share[label] == size / min(size, bound)
        # Below the window of the ranks stands a filter on the hash range.
        plan = sample._jdf.queryExecution().optimizedPlan().toString().split("row_number()")[-1]
        assert ("shiftright" in plan.lower() and "<=" in plan) == (bound == 40)
