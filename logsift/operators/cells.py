"""Exact nearest neighbours through a metric partition: a store cut into cells, joined by candidate cells.

Pivots, about as many as the root of the number of vectors, cut the store into cells; a cell knows the
least and the largest angle of its members to its pivot. Angles obey the triangle inequality: a member
within ``reach`` of a query is in a cell whose range of angles, widened by the reach, holds the query's angle to the
pivot. So each query has its own list of candidate cells, and the others are never multiplied.

A query first searches the cell of its nearest pivot. The k-th best hit found there, or the threshold
if that is nearer, is the reach of the second search over all other candidates. The result is
that of a full comparison, ties included.

The partition is a written table and may serve many searches. A store row is in one
cell; cells beyond a block's size are cut by hash, as are the queries that ask for one cell, so no task holds
more than two blocks, however many rows resemble each other.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.operators.blocks import HIT_SCHEMA, best_in_block, matrix, tasks_for
from logsift.staging import stage

# Pivots and the table of cells are sent to every task.
MOST_PIVOTS = 4096
# Similarities are rounded at the twelfth digit, which near 1 is an angle of about 1.4e-6.
_SLACK = 1e-5


@dataclass(frozen=True)
class Cells:
    """What is known of each cell, by its number; the last one holds the zero vectors, which have no angle."""

    pivots: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    blocks: np.ndarray

    def angles(self, units: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(units @ self.pivots.T, -1.0, 1.0))

    def candidates(self, units: np.ndarray, reach: np.ndarray, before: np.ndarray | None) -> np.ndarray:
        """(queries, cells): where a row within ``reach`` may be; ``before`` keeps cells with a smaller id than that."""
        found = np.zeros((len(units), len(self.rows)), bool)
        angle, zero = self.angles(units), ~units.any(axis=1)
        near = reach[:, None] + _SLACK
        found[:, :-1] = (angle >= self.low[None, :-1] - near) & (angle <= self.high[None, :-1] + near) | zero[:, None]
        found[:, -1] = reach + _SLACK >= math.pi / 2  # a zero vector is similar 0 to everything
        found &= self.rows[None] > 0
        if before is not None:
            found &= self.first[None] < before[:, None]
        return found


@dataclass(frozen=True)
class MetricPartition:
    """``rows``: ``sid, svec, cell, block``, a written table."""

    rows: DataFrame
    cells: Cells
    block_rows: int

    def search(self, queries: DataFrame, k: int = 1, threshold: float | None = None, earlier_only: bool = False) -> DataFrame:
        """``(qid, sid, sim, rank)``: the ``k`` best rows of each query (``qid, qvec``, finite), as ``similarity.top_matches`` gives them."""
        limit = math.pi if threshold is None else math.acos(max(-1.0, min(1.0, threshold)))
        home = stage(_asked(queries.withColumns({"bound": F.lit(limit), "home": F.lit(-1)}), self.cells, True, earlier_only), "home")
        hits = stage(self._hits(home, k, threshold, earlier_only), "hits")
        worst = F.when(F.count("*") >= k, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.min("sim"))))).otherwise(F.lit(limit))
        bounds = best_hits(hits, k).groupBy("qid").agg(worst.alias("angle"))
        known = home.select("qid", "qvec", F.get("asked", F.lit(0)).alias("home")).join(bounds, "qid", "left")
        known = known.withColumns({"bound": F.least(F.coalesce("angle", F.lit(limit)), F.lit(limit)), "home": F.coalesce("home", F.lit(-1))})
        rest = stage(_asked(known.drop("angle"), self.cells, False, earlier_only), "rest")
        return best_hits(hits.unionByName(self._hits(rest, k, threshold, earlier_only)), k)

    def multiplied(self, asked: DataFrame) -> float:
        """Share of all query and store rows that lists of cells (``asked``) compare."""
        sizes = {i: int(n) for i, n in enumerate(self.cells.rows) if n}
        per = asked.select(F.explode("asked").alias("cell")).groupBy("cell").count().collect()
        return sum(r["count"] * sizes[r["cell"]] for r in per) / max(1, asked.count() * sum(sizes.values()))

    def _hits(self, asked: DataFrame, k: int, threshold: float | None, earlier_only: bool) -> DataFrame:
        """The best ``k`` rows of each query and block among the cells that the queries ask for; ``asked`` is a written table."""
        spark = asked.sparkSession
        spread = asked.select("qid", "qvec", F.explode("asked").alias("cell"))
        wanted = {r["cell"]: r["count"] for r in asked.select(F.explode("asked").alias("cell")).groupBy("cell").count().collect()}
        if not wanted:
            return spark.createDataFrame([], HIT_SCHEMA)
        table = [(c, int(self.cells.blocks[c]), math.ceil(n / self.block_rows)) for c, n in wanted.items()]
        plan = F.broadcast(spark.createDataFrame(table, "cell int, blocks int, parts int"))  # a row per cell
        left = spread.join(plan, "cell").withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int"))
        left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", "block", "part", "qid", "qvec")
        right = self.rows.join(plan, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        right = right.select("cell", "block", "part", "sid", "svec")

        def block(queries: pa.Table, store: pa.Table) -> pa.Table:
            found = ([], [], [])
            if queries.num_rows and store.num_rows:
                sides = [(t.column(i).to_numpy(), matrix(t.column(v))) for t, i, v in ((queries, "qid", "qvec"), (store, "sid", "svec"))]
                found = best_in_block(*sides[0], *sides[1], k, threshold, earlier_only)
            return pa.table({"qid": pa.array(found[0], pa.int64()), "sid": pa.array(found[1], pa.int64()), "sim": pa.array(found[2], pa.float64())})

        keys, tasks = ["cell", "block", "part"], tasks_for(spark, sum(b * p for _, b, p in table))
        left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(block, HIT_SCHEMA)


def best_hits(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query, smaller id first among equals, with their ``rank``."""
    if k == 1:
        best = hits.groupBy("qid").agg(F.max(F.struct(F.col("sim"), (-F.col("sid")).alias("neg"))).alias("b"))
        return best.select("qid", (-F.col("b.neg")).alias("sid"), F.col("b.sim").alias("sim"), F.lit(1).alias("rank"))
    order = Window.partitionBy("qid").orderBy(F.desc("sim"), "sid")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _asked(queries: DataFrame, cells: Cells, first: bool, earlier_only: bool) -> DataFrame:
    """``qid, qvec, asked``: the nearest cell with a candidate, or all candidate cells but ``home``.

    ``queries``: qid, qvec, bound (the angle that a hit may have), home.
    """

    def ask(batches):
        for batch in batches:
            units = matrix(batch.column(batch.schema.get_field_index("qvec")))
            qid, reach, home = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("qid", "bound", "home"))
            found = cells.candidates(units, reach, qid if earlier_only else None) if len(qid) else np.zeros((0, len(cells.rows)), bool)
            if first:
                # Distance from the cell's pivot; the cell of zero vectors comes last.
                angle = np.where(found, np.column_stack([cells.angles(units), np.full(len(units), 4.0)]), np.inf) if len(qid) else found
                nearest = angle.argmin(axis=1) if len(qid) else np.zeros(0, int)
                lists = [[int(c)] if found[i, c] else [] for i, c in enumerate(nearest)]
            else:
                found[np.flatnonzero(home >= 0), home[home >= 0].astype(int)] = False
                lists = [np.flatnonzero(f) for f in found]
            yield pa.record_batch([batch.column(batch.schema.get_field_index("qid")), batch.column(batch.schema.get_field_index("qvec")), pa.array(lists, pa.list_(pa.int32()))], ["qid", "qvec", "asked"])

    kept = [f for f in queries.schema.fields if f.name in ("qid", "qvec")]
    return queries.select("qid", "qvec", "bound", "home").mapInArrow(ask, T.StructType(sorted(kept, key=lambda f: f.name)).add("asked", T.ArrayType(T.IntegerType())))


def _pivots(store: DataFrame, rows: int, wanted: int) -> np.ndarray:
    """Distinct nonzero vectors, chosen by their hash."""
    every = max(1, rows // (2 * wanted))
    nonzero = store.where(F.exists("svec", lambda x: x != 0)).select("svec")
    for share in (every, 1):
        chosen = nonzero.where(F.pmod(F.xxhash64("svec"), F.lit(share)) == 0).distinct().limit(wanted).toArrow()
        if chosen.num_rows:
            break
    return matrix(chosen.column("svec"))


def partition(store: DataFrame, rows: int, block_rows: int, pivots: int | None = None) -> MetricPartition:
    """Cuts ``store`` (``sid, svec``, finite; ``rows`` of them) into cells around ``pivots`` vectors."""
    wanted = max(1, min(MOST_PIVOTS, pivots or math.isqrt(rows)))
    centres = _pivots(store, rows, wanted)
    last = len(centres)

    def place(batches):
        for batch in batches:
            units = matrix(batch.column(batch.schema.get_field_index("svec")))
            cell, angle = np.full(len(units), last), np.zeros(len(units))
            real = np.flatnonzero(units.any(axis=1))
            if last and len(real):
                sims = np.clip(units[real] @ centres.T, -1.0, 1.0)
                cell[real] = sims.argmax(axis=1)
                angle[real] = np.arccos(sims[np.arange(len(real)), cell[real]])
            yield batch.append_column("cell", pa.array(cell, pa.int32())).append_column("angle", pa.array(angle, pa.float64()))

    schema = T.StructType(list(store.schema.fields)).add("cell", T.IntegerType()).add("angle", T.DoubleType())
    placed = stage(store.mapInArrow(place, schema), "cells")
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"), F.min("sid").alias("first")).collect()
    cells = Cells(centres, *(np.zeros(last + 1, kind) for kind in (int, float, float, int, int)))
    for r in stats:  # at most one row per pivot
        i = r["cell"]
        cells.rows[i], cells.low[i], cells.high[i], cells.first[i], cells.blocks[i] = r["n"], r["low"], r["high"], r["first"], math.ceil(r["n"] / block_rows)
    table = [(i, int(n)) for i, n in enumerate(cells.blocks) if n]
    sizes = F.broadcast(store.sparkSession.createDataFrame(table, "cell int, blocks int"))
    cut = placed.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    return MetricPartition(cut.select("sid", "svec", "cell", "block"), cells, block_rows)
