"""Nearest neighbours, leaders and reuse against plain loops."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsift.operators.batching import entry_verdicts
from logsift.operators.classify import python_classifier
from logsift.operators.embed import encoder_embedding, hashed_embedding
from logsift.operators.leaders import follow, select_leaders
from logsift.operators import cells, similarity
from logsift.operators.cells import partition
from logsift.operators.similarity import search, search_batch, top_matches, top_matches_once
from logsift.plans.timing import StageTimings
from logsift.plans.triage import ReuseOptions, triage_and_store, triage_with_reuse
from logsift.schemas import STORE
from logsift.sources.store import VectorStore


def unit(rows):
    rows = np.asarray(rows, dtype=float)
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length == 0, 1, length)


def clustered(n, dim, seed, clusters=12, spread=0.25):
    """Clusters of near copies; a third of all rows are exact copies of one vector."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    rows = centres[rng.integers(clusters, size=n)] + spread * rng.normal(size=(n, dim))
    rows[rng.permutation(n)[: n // 3]] = rows[0]
    rows[n // 2] = 0.0
    return rows.astype(np.float32).astype(float)


def frame(spark, rows, names="ord long, vec array<double>"):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(rows)], names)


def loop_leaders(rows, threshold):
    units, leaders = unit(rows), []
    for i in range(len(units)):
        if not any(round(float(units[i] @ units[j]), 12) >= threshold for j in leaders):
            leaders.append(i)
    return leaders


def loop_top(queries, store, k, threshold, earlier):
    sims = np.round(unit(queries) @ unit(store).T, 12)
    hits = {}
    for q in range(len(queries)):
        found = [(-sims[q, s], s) for s in range(len(store)) if sims[q, s] >= threshold and not (earlier and s >= q)]
        for rank, (sim, s) in enumerate(sorted(found)[:k]):
            hits[q, rank + 1] = (s, -sim)
    return hits


def assert_same_hits(got, want):
    got = {(r["qid"], r["rank"]): (r["sid"], r["sim"]) for r in got}
    assert {key: sid for key, (sid, _) in got.items()} == {key: sid for key, (sid, _) in want.items()}
    assert all(abs(got[key][1] - want[key][1]) < 1e-9 for key in want)


@pytest.mark.parametrize(
    "k, threshold, earlier, options",
    [
        (1, -2.0, False, {}),
        (3, 0.8, False, {"block_rows": 40, "pivots": 6}),
        (1, 0.9, True, {"block_rows": 40, "pivots": 6}),
        (20, 0.5, True, {"block_rows": 60, "pivots": 1}),
        (2, 0.0, False, {"block_rows": 64, "pivots": 5}),
    ],
)
def test_top_matches_equal_a_full_comparison(spark, k, threshold, earlier, options):
    rows, store = clustered(230, 8, 1), clustered(230, 8, 1 if earlier else 2)
    got = top_matches(
        frame(spark, rows, "qid long, qvec array<double>"), frame(spark, store, "sid long, svec array<double>"),
        k=k, threshold=None if threshold == -2.0 else threshold, earlier_only=earlier, **options,
    ).collect()
    want = loop_top(rows, store, k, threshold, earlier)
    assert_same_hits(got, want)


@pytest.mark.parametrize("k, threshold, earlier", [(1, 0.9, False), (1, 0.9, True), (4, None, False), (4, None, True), (3, -0.5, False), (2, 1.0, False)])
def test_cells_give_the_hits_of_a_full_comparison(spark, k, threshold, earlier):
    rows = clustered(400, 8, 4, clusters=30, spread=0.05)
    rows[7] = rows[13] = 0.0
    frames = frame(spark, rows, "qid long, qvec array<double>"), frame(spark, rows, "sid long, svec array<double>")
    got = top_matches(*frames, k=k, threshold=threshold, earlier_only=earlier, block_rows=50, pivots=20).collect()
    assert_same_hits(got, loop_top(rows, rows, k, -2.0 if threshold is None else threshold, earlier))


def test_few_blocks_meet_on_clustered_vectors(spark):
    """Candidate cells hold under a fifth of all pairs, hits are those of a full comparison, and the store moves once."""
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(60, 16))[rng.integers(60, size=3000)] + 0.04 * rng.normal(size=(3000, 16))
    queries, store = frame(spark, rows[:500] + 0.01, "qid long, qvec array<double>"), frame(spark, rows, "sid long, svec array<double>")
    cut = partition(store, 3000, 100)
    assert abs(len(cut.cells.pivots) - 54) <= 10  # the root of the number of vectors, as far as their hashes go
    for threshold, share in ((0.95, 0.2), (None, 0.2)):
        limit = np.pi if threshold is None else np.arccos(threshold)
        home = cells._asked(queries.withColumns({"bound": F.lit(float(limit)), "home": F.lit(-1)}), cut.cells, True, False)
        known = home.select("qid", "qvec", F.get("asked", F.lit(0)).alias("home")).withColumn("bound", F.lit(0.35))
        assert cut.multiplied(home) + cut.multiplied(cells._asked(known, cut.cells, False, False)) < share
        assert_same_hits(cut.search(queries, 2, threshold).collect(), loop_top(rows[:500] + 0.01, rows, 2, threshold or -2.0, False))


def test_copies_are_compared_once(spark):
    rows = clustered(90, 6, 5)
    queries, store = frame(spark, rows, "qid long, qvec array<double>"), frame(spark, rows[::2], "sid long, svec array<double>").withColumn("sid", F.col("sid") * 2)
    sims = np.round(unit(rows) @ unit(rows).T, 12)
    for earlier in (False, True):
        got = {r.qid: (r.sid, round(r.sim, 9)) for r in top_matches_once(queries, store, 0.8, earlier, block_rows=20).collect()}
        want = {}
        for q in range(90):
            found = [(-sims[q, s], s) for s in range(0, 90, 2) if sims[q, s] >= 0.8 and not (earlier and s >= q)]
            if found:
                want[q] = (min(found)[1], round(-min(found)[0], 9))
        assert got == want


def test_small_blocks_do_not_copy_every_row_for_each_of_them(spark, monkeypatch):
    """A block of 4 of 400 rows would copy every row 100 times, in cells as in a full comparison."""
    rows, made = clustered(400, 8, 11), []
    frames = frame(spark, rows, "qid long, qvec array<double>"), frame(spark, rows, "sid long, svec array<double>")
    cut, compared = similarity.partition, similarity._compare_all
    monkeypatch.setattr(similarity, "partition", lambda store, n, size, pivots: made.append(size) or cut(store, n, size, pivots))
    monkeypatch.setattr(similarity, "_compare_all", lambda *args: made.append(args[-1]) or compared(*args))
    for pivots in (1, 6):
        got = {(r.qid, r.rank): (r.sid, r.sim) for r in top_matches(*frames, k=2, threshold=0.8, block_rows=4, pivots=pivots).collect()}
        want = loop_top(rows, rows, 2, 0.8, False)
        assert {key: s for key, (s, _) in got.items()} == {key: s for key, (s, _) in want.items()}
        assert all(abs(got[key][1] - want[key][1]) < 1e-10 for key in want)
    assert len(made) == 2 and all(400 / size <= 8 for size in made)
    # A given size stays where it means few copies, and memory bounds what it grows to.
    assert similarity._grown(128, 500, 500, 64, 8) == 128
    assert similarity._grown(128, 10**8, 10**8, 64, 8) * 64 * 8 == similarity._GROWN_BYTES


def test_out_of_reach_nothing_is_compared(spark, monkeypatch):
    """No similarity is above 1: every row leads, also copies and zero vectors, and no two blocks meet."""

    def never(*args, **kwargs):
        raise AssertionError("blocks were compared")

    for name in ("partition", "_compare_all", "best_in_block"):
        monkeypatch.setattr(similarity, name, never)
    rows = clustered(120, 4, 3)
    df = frame(spark, rows)
    assert sorted(r["ord"] for r in select_leaders(df, 1.5, head_rows=20).collect()) == list(range(120))
    assert follow(df, df, 1.5).isEmpty() and follow(df, df, 1.5).columns == ["ord", "leader", "sim"]
    found = top_matches(frame(spark, rows, "qid long, qvec array<double>"), frame(spark, rows, "sid long, svec array<double>"), threshold=1.0000001)
    assert found.isEmpty() and found.columns == ["qid", "sid", "sim", "rank"]


def test_collected_lines_are_cased_once(spark):
    entries = F.array(*[F.struct(F.lit(i).cast("long").alias("index"), F.lit("f").alias("source_file"), text.alias("raw_text")) for i, text in enumerate([F.lit("fine"), F.concat(F.lit("x"), F.col("word"))])])
    words = spark.createDataFrame([(0, "timeOut"), (1, " 500 "), (2, 'HTTP/1.1" 503'), (3, "ok"), (4, None)], "batch_id long, word string")
    found = entry_verdicts(words.select("batch_id", entries.alias("entries")))
    assert {r["batch_id"]: r["error_found"] for r in found.collect()} == {0: True, 1: True, 2: True, 3: False, 4: None}
    flag = found.select("error_found")._jdf.queryExecution().analyzed().toString()
    assert flag.count("upper(") == 1


def test_long_stored_texts_are_sorted_in_small_chunks(spark):
    rows = spark.range(3000).select(
        (2999 - F.col("id")).alias("batch_id"), F.array(F.lit(1.0)).alias("vector"), F.concat(F.lit("t"), 2999 - F.col("id")).alias("raw_text"),
        F.lit(True).alias("is_error"), F.lit("m").alias("model_name"), F.lit("e").alias("embedder_model_name"),
    )
    made = VectorStore.with_ids(rows, "batch_id", 10)
    assert sorted((r["id"], r["raw_text"]) for r in made.collect()) == [(i + 11, f"t{i}") for i in range(3000)]
    assert "div 1024" in made._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("threshold", [0.8, 0.95, 1.0])
@pytest.mark.parametrize("head_rows, options", [(4096, {}), (25, {"block_rows": 50, "pivots": 4}), (7, {"block_rows": 90})])
def test_leaders_equal_the_loop(spark, threshold, head_rows, options):
    rows = clustered(150, 6, int(threshold * 100))
    got = sorted(r["ord"] for r in select_leaders(frame(spark, rows), threshold, head_rows, **options).collect())
    assert got == loop_leaders(rows, threshold)


def test_leaders_of_a_slow_drift(spark):
    """Each row resembles its neighbours only: the worst order for parallel rounds."""
    angles = np.arange(160) * 0.05
    rows = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    got = sorted(r["ord"] for r in select_leaders(frame(spark, rows), 0.99, head_rows=40).collect())
    assert got == loop_leaders(rows, 0.99)


def test_followers_take_the_nearest_earlier_leader(spark):
    rows = clustered(150, 6, 9)
    df, chosen = frame(spark, rows), loop_leaders(rows, 0.8)
    leaders = df.where(F.col("ord").isin(chosen))
    got = {r["ord"]: r["leader"] for r in follow(df.where(~F.col("ord").isin(chosen)), leaders, 0.8).collect()}
    sims = np.round(unit(rows) @ unit(rows).T, 12)
    want = {i: max((j for j in chosen if j < i), key=lambda j: (sims[i, j], -j)) for i in range(len(rows)) if i not in chosen}
    assert got == want


# ---- store ------------------------------------------------------------------


def test_empty_store_gives_empty_lists(spark):
    empty = spark.createDataFrame([], STORE)
    queries = frame(spark, [[1.0, 0.0], [0.0, 1.0]], "qid long, qvec array<double>")
    assert [(r["qid"], r["hits"]) for r in search_batch(queries, empty).orderBy("qid").collect()] == [(0, []), (1, [])]
    assert search([1.0, 0.0], empty).collect() == []
    assert search_batch(queries.where("false"), empty).collect() == []


STORED = "batch_id long, vector array<double>, raw_text string, is_error boolean, model_name string, embedder_model_name string"


def _rows_to_store(spark, names, slices=4):
    return spark.createDataFrame([(i, [1.0, float(i)], n, False, n, None) for i, n in enumerate(names)], STORED).repartition(slices)


def test_a_failing_insert_leaves_no_row(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "store")).create_if_missing()
    store.insert(_rows_to_store(spark, "abc"))
    broken = F.when(F.col("raw_text") == "x", F.raise_error(F.lit("broken"))).otherwise(F.col("raw_text"))
    with pytest.raises(Exception, match="broken"):
        store.insert(_rows_to_store(spark, "uvwxyz").withColumn("raw_text", broken.cast("string")))
    assert [r["raw_text"] for r in store.read().orderBy("id").collect()] == list("abc")
    assert not [p for p in (tmp_path / "store").iterdir() if p.name.startswith("_pending")]
    store.insert(_rows_to_store(spark, "").limit(0))
    store.insert(_rows_to_store(spark, "d"))
    assert [(r["id"], r["raw_text"]) for r in store.read().orderBy("id").collect()] == list(zip((1, 2, 3, 4), "abcd", strict=True))


def test_an_insert_that_lost_its_ids_is_numbered_again(spark, tmp_path):
    store, other = (VectorStore(spark, str(tmp_path / "store")).create_if_missing() for _ in range(2))
    store.insert(_rows_to_store(spark, "ab"))
    ask, asked = store.last_id, []

    def last_id():
        last = ask()
        if not asked:  # another writer commits between the look at the ids and the commit
            asked.append(last)
            other.insert(_rows_to_store(spark, "cde"))
        return last

    store.last_id = last_id
    store.insert(_rows_to_store(spark, "fg"))
    assert [(r["id"], r["raw_text"]) for r in store.read().orderBy("id").collect()] == list(zip(range(1, 8), "abcdefg", strict=True))


def test_stage_timings_of_a_stream(spark, tmp_path):
    timings = StageTimings()
    spark.createDataFrame([(f"line {i}", float(i)) for i in range(10)], "text string, ms double").write.parquet(str(tmp_path / "in"))
    stream = timings.watch(spark.readStream.schema("text string, ms double").parquet(str(tmp_path / "in")), "read", "ms")
    spark.streams.addListener(timings)
    try:
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination(60)
        for _ in range(50):
            if timings.table(spark).count():
                break
            time.sleep(0.1)
        assert [tuple(r) for r in timings.table(spark).collect()] == [("read", 0, 10, 45.0, 9.0)]
    finally:
        spark.streams.removeListener(timings)


def test_store_ids_names_and_limits(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "store"))
    assert not store.exists()
    store.create_if_missing()
    assert store.read().collect() == [] and store.last_id() == 0
    rows = [(5, [1.0, 0.0], "five", True, "", None), (3, [0.0, 1.0], "three", False, "m", "e")]
    names = "batch_id long, vector array<double>, raw_text string, is_error boolean, model_name string, embedder_model_name string"
    store.insert(spark.createDataFrame(rows, names))
    store.insert(spark.createDataFrame(rows[:1], names))
    got = [(r["id"], r["raw_text"], r["model_name"], r["embedder_model_name"]) for r in store.read().orderBy("id").collect()]
    assert got == [(1, "three", "m", "e"), (2, "five", None, None), (3, "five", None, None)]
    hit = search([2.0, 0.1], store.read()).first()
    assert (hit["rank"], hit["id"], hit["entity"]["raw_text"]) == (1, 2, "five")
    long = [(1, [1.0, 0.0], "x" * 70_000, True, "m" * 300, None)]
    store.insert(spark.createDataFrame(long, names))
    store.create_if_missing()
    last = store.read().orderBy("id").collect()[-1]
    assert (last["id"], len(last["raw_text"]), len(last["model_name"])) == (4, 70_000, 300)
    store.clear()
    assert store.read().count() == 0


# ---- reuse ------------------------------------------------------------------


def loop_reuse(rows, texts, stored, threshold, verdict, fails):
    """Look up, else classify and store, one batch after another."""
    units, table, out = unit(rows), [(unit([v])[0], flag, "old", i + 1) for i, (v, flag) in enumerate(stored)], []
    for i, u in enumerate(units):
        sims = [round(float(u @ v), 12) for v, *_ in table]
        best = max(range(len(sims)), key=lambda j: (sims[j], -j), default=None)
        if best is not None and sims[best] >= threshold:
            out.append((i, table[best][1], table[best][2], "stored" if table[best][2] == "old" else "run", table[best][3]))
        elif fails(i):
            out.append((i, True, "new", "failed", None))
        else:
            table.append((u, verdict(i), "new", i))
            out.append((i, verdict(i), "new", "classified", None))
    return out


@pytest.mark.parametrize("n_stored, failing, head_rows", [(0, 0, 4096), (5, 3, 4096), (3, 2, 30)])
def test_reuse_equals_the_loop(spark, n_stored, failing, head_rows):
    rng = random.Random(n_stored + failing)
    rows = clustered(110, 6, 20 + failing)
    texts = ["é" * 40_000 if i % 17 == 4 else f"text {i}" for i in range(len(rows))]
    stored = [(rows[rng.randrange(len(rows))] + 0.05, bool(i % 2)) for i in range(n_stored)]
    fails = lambda i: bool(failing) and i % failing == 0
    data = [(i, [(i, "f", texts[i])], texts[i], [float(x) for x in row]) for i, row in enumerate(rows)]
    batches = spark.createDataFrame(
        data, "batch_id long, entries array<struct<index:long, source_file:string, raw_text:string>>, text string, vec array<double>"
    )
    store = spark.createDataFrame(
        [(i + 1, [float(x) for x in v], "old", flag, "old", "enc") for i, (v, flag) in enumerate(stored)], STORE
    )

    def factory():
        def analyze(batch_id, entries):
            if failing and batch_id % failing == 0:
                raise ValueError("no")
            return batch_id % 3 == 1

        return analyze

    options = ReuseOptions(0.9, "enc", head_rows)
    result = triage_with_reuse(batches, store, python_classifier(factory, "new"), options)
    got = [
        (r["batch_id"], r["error_found"], r["model_name"] or "new", r["origin"], r["matched_id"])
        for r in result.verdicts.orderBy("batch_id").collect()
    ]
    # Store vectors are floats; compare with the same rounding.
    as_float = [(np.asarray(v, dtype=np.float32).astype(float), flag) for v, flag in stored]
    want = loop_reuse(rows, texts, as_float, 0.9, lambda i: i % 3 == 1, fails)
    assert got == want
    assert result.new_rows.count() == sum(row[3] == "classified" for row in want)


def test_second_run_answers_from_the_store(spark, tmp_path):
    rows = clustered(60, 6, 31)[:29]
    data = [(i, [(i, "f", f"t{i}")], f"t{i}", [float(x) for x in row]) for i, row in enumerate(rows)]
    batches = spark.createDataFrame(
        data, "batch_id long, entries array<struct<index:long, source_file:string, raw_text:string>>, text string, vec array<double>"
    )
    store = VectorStore(spark, str(tmp_path / "store"))
    first = triage_and_store(batches, store, options=ReuseOptions(0.9))
    n_stored = store.read().count()
    assert n_stored == first.where("origin = 'classified'").count() > 0
    second = triage_and_store(batches, store, options=ReuseOptions(0.9))
    assert {r["origin"] for r in second.collect()} == {"stored"} and store.read().count() == n_stored
    third = triage_and_store(batches, store, options=ReuseOptions(0.9), clear_store=True)
    assert third.where("origin = 'classified'").count() == n_stored == store.read().count()


# ---- encoders ---------------------------------------------------------------


def test_hashed_embedding_ignores_masked_parts(spark):
    df = spark.createDataFrame([(0, "uid 7 from 10.0.0.1"), (1, "uid 99 from 10.9.9.9"), (2, "other words")], "i int, t string")
    rows = [np.array(r["vec"]) for r in hashed_embedding(df, "t", dimension=64).orderBy("i").collect()]
    assert np.allclose(rows[0], rows[1]) and rows[0] @ rows[2] < 0.9 and np.allclose(np.linalg.norm(rows, axis=1), 1)


def test_user_encoder_is_normalised(spark):
    df = spark.createDataFrame([(0, "aa"), (1, "")], "i int, t string")
    factory = lambda: lambda texts: np.array([[3.0 * len(t), 4.0 * len(t)] for t in texts])
    rows = [r["vec"] for r in encoder_embedding(df, "t", factory).orderBy("i").collect()]
    assert np.allclose(rows, [[0.6, 0.8], [0.0, 0.0]])
