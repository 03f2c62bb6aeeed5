"""Greedy leader selection over an ordered set of vectors.

Row *i* is a leader unless an earlier leader is at least ``threshold`` similar
to it: the result of a loop that looks up each row and stores it on a miss.
Every round decides rows in two ways, and both give what the loop gives:

* the first ``head_rows`` undecided rows depend on nothing undecided outside
  them, so one bounded task runs the loop over them;
* of the rows left, one without any earlier undecided neighbour is a leader.

Each kind of new leader then turns its later neighbours into followers. The
neighbour lists themselves are never built.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.operators.blocks import DIGITS, matrix
from logsift.operators.similarity import _nonzero, held_in_blocks, top_matches, top_matches_once
from logsift.staging import scratch_path, stage, stage_at

HEAD_ROWS = 4096


def _as_queries(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("ord").alias("qid"), F.col("vec").alias("qvec"))


def _as_store(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("ord").alias("sid"), F.col("vec").alias("svec"))


def _head_leaders(rows: DataFrame, threshold: float, head_rows: int) -> DataFrame:
    """The loop itself over the first rows; ``limit`` bounds what the task gets."""

    def loop(table: pa.Table) -> pa.Table:
        table = table.sort_by("ord")
        units = matrix(table.column("vec"))
        blocked = np.zeros(len(units), dtype=bool)
        leaders = []
        for i in range(len(units)):
            if not blocked[i]:
                leaders.append(i)
                later = np.round(units[i + 1 :] @ units[i], DIGITS) >= threshold
                blocked[i + 1 :] |= later
        return table.select(["ord", "vec"]).take(pa.array(leaders, pa.int64()))

    head = rows.select("ord", "vec").orderBy("ord").limit(head_rows)
    return head.groupBy().applyInArrow(loop, rows.select("ord", "vec").schema)


def _first_copies(rows: DataFrame, threshold: float) -> DataFrame:
    """One row per distinct vector; later copies always follow the first one.

    Combined before the shuffle, so a vector with very many copies costs one
    row per task. Zero vectors resemble nothing and are kept apart.
    """
    rows = rows.select("ord", "vec")
    if not 0 < threshold <= 1:
        return rows
    alone = F.when(_nonzero("vec"), F.lit(None)).otherwise(F.col("ord"))
    return (
        rows.withColumn("_alone", alone)
        .groupBy("vec", "_alone")
        .agg(F.min("ord").alias("ord"))
        .select("ord", "vec")
    )


def _without(rows: DataFrame, decided: DataFrame) -> DataFrame:
    return rows.join(decided.select(F.col("qid").alias("ord")), "ord", "left_anti")


def _held_back(rest: DataFrame, threshold: float, **search) -> DataFrame:
    """``qid`` of the rows with an earlier undecided neighbour.

    Rows held back inside their own block are not looked up in the others.
    """
    store = _as_store(rest)
    nearby = stage(held_in_blocks(store, threshold, **search), "held")
    open_rows = stage(_without(rest, nearby), "open")
    far = top_matches(_as_queries(open_rows), store, threshold=threshold, earlier_only=True, **search)
    return stage(nearby.unionByName(far.select("qid")), "held")


def select_leaders(rows: DataFrame, threshold: float, head_rows: int = HEAD_ROWS, **search) -> DataFrame:
    """The leaders, as ``(ord, vec)``, of rows with a unique order ``ord`` and a vector ``vec``.

    They are a written table; every round adds its leaders to it.
    """
    spark = rows.sparkSession
    undecided = stage(_first_copies(rows, threshold), "undecided")
    path, part = scratch_path(spark, "leaders"), 0
    while True:
        leaders = stage_at(_head_leaders(undecided, threshold, head_rows), f"{path}/part={part}")
        if undecided.count() <= head_rows:
            break
        last = undecided.select("ord").orderBy("ord").limit(head_rows).agg(F.max("ord")).first()[0]
        rest = undecided.where(F.col("ord") > last)
        followers = top_matches(_as_queries(rest), _as_store(leaders), threshold=threshold, **search)
        rest = stage(_without(rest, followers), "rest")

        held = _held_back(rest, threshold, **search)
        free = stage_at(_without(rest, held), f"{path}/part={part + 1}")
        waiting = stage(rest.join(held.select(F.col("qid").alias("ord")), "ord", "left_semi"), "waiting")
        followers = top_matches(
            _as_queries(waiting), _as_store(free), threshold=threshold, earlier_only=True, **search
        )
        undecided = stage(_without(waiting, followers), "undecided")
        part += 2
    return spark.read.schema(undecided.schema).parquet(path).select("ord", "vec")


def follow(rows: DataFrame, leaders: DataFrame, threshold: float, **search) -> DataFrame:
    """``(ord, leader, sim)``: the most similar earlier leader of each row that has one.

    ``rows`` should not hold the leaders. Equal vectors are looked up once; a copy that comes
    before the best of all leaders sees fewer leaders and is looked up again.
    """
    found = top_matches_once(_as_queries(rows), _as_store(leaders), threshold, True, **search)
    return found.select(F.col("qid").alias("ord"), F.col("sid").alias("leader"), "sim")
