"""What keeps the jobs whole and even on large, skewed data."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from logsift.operators.indexing import index_ordered
from logsift.operators.leaders import _first_copies
from logsift.operators.skew import SALTS, join_unique
from logsift.plans.triage import triage_batches
from logsift.staging import scratch_path, shared_dir, stage, temporary_stages


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [500_000, 3, 0])
def test_hot_key_join_keeps_every_row(spark, limit):
    facts = spark.range(600).select(
        F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("key")
    )
    unique = spark.range(40).select(F.col("id").alias("key"), (F.col("id") * 10).alias("value"))
    joined = join_unique(facts, unique, "key", broadcast_bytes=limit)
    got = sorted((r["row"], r["key"], r["value"]) for r in joined.select("row", "key", "value").collect())
    keys = [(i, 7 if i % 3 == 0 else i % 50) for i in range(600)]
    assert got == [(i, k, k * 10) for i, k in keys if k < 40]


def test_salts_spread_a_hot_key(spark):
    salted = spark.range(3000).select(F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("s"))
    sizes = [r["count"] for r in salted.groupBy("s").count().collect()]
    assert len(sizes) == SALTS and max(sizes) < 2 * 3000 / SALTS


def test_large_sides_of_a_hot_key_join_are_not_broadcast(spark):
    rows = spark.range(4000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("key"))
    unique = stage(spark.range(4000).select(F.col("id").alias("key"), F.lit("table").alias("name")), "unique")
    joined = join_unique(stage(rows, "facts"), unique, "key", broadcast_bytes=0, facts_per_copy=100)
    plan = plan_of(joined)
    # The 1,334 facts of key 7 meet copies of its row; only the list of such keys is broadcast, and no other row is copied.
    assert plan.count("SortMergeJoin") == 1 and "_copies" in plan
    assert all("name#" not in row for row in plan.splitlines() if "BroadcastExchange" in row)
    assert sorted((r["row"], r["key"], r["name"]) for r in joined.collect()) == [(i, 7 if i % 3 == 0 else i, "table") for i in range(4000)]
    even = join_unique(stage(spark.range(4000).select(F.col("id").alias("key")), "facts"), unique, "key", broadcast_bytes=0, facts_per_copy=100)
    assert "BroadcastHashJoin" not in plan_of(even) and "Generate" not in plan_of(even) and even.count() == 4000


def test_copies_are_combined_before_the_shuffle(spark):
    rows = spark.range(1000).select(F.col("id").alias("ord"), F.array(F.lit(1.0), F.col("id") % 2).alias("vec"))
    copies = _first_copies(rows, 0.8)
    plan = plan_of(copies)
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange") == 1
    assert sorted(r["ord"] for r in copies.collect()) == [0, 1]


def test_ordered_index_moves_the_lines_once(spark):
    lines = spark.range(1000).select(
        F.concat(F.lit("hot"), F.col("id") % 1).alias("source_file"), F.col("id").alias("line_no"), F.lit("x").alias("raw_text")
    )
    plan = plan_of(index_ordered(lines, chunk=100))
    moves = [row for row in plan.splitlines() if "Exchange hashpartitioning(_part" in row and "ENSURE_REQUIREMENTS" in row]
    assert len(moves) == 1 and "SinglePartition" not in plan.split("Window", 1)[0]


def test_keyword_verdicts_move_no_text(spark):
    lines = spark.range(1000).select(
        F.col("id").alias("index"), F.lit("f").alias("source_file"), F.lit("ERROR x").alias("raw_text")
    )
    plan = plan_of(triage_batches(lines))
    assert "collect_list" not in plan and "partial_max" in plan


def test_stages_live_in_the_shared_folder(spark):
    path = scratch_path(spark, "x")
    assert path.startswith(shared_dir(spark))
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_dir(spark) == configured.rstrip("/")


def test_temporary_stages_are_removed(spark):
    with temporary_stages(spark):
        kept = stage(spark.range(3), "inside")
        folder = kept.inputFiles()[0].replace("file://", "")
        assert os.path.exists(folder)
    assert not os.path.exists(os.path.dirname(folder))
    outside = stage(spark.range(3), "outside")
    assert os.path.exists(outside.inputFiles()[0].replace("file://", ""))
