"""Exact cosine nearest-neighbour join, cut into bounded blocks.

Both sides are spread over blocks of at most a few ten thousand vectors. A
task gets one query block and one store block, multiplies them with NumPy and
returns the best ``k`` store rows per query, so no pair ever becomes a row.
A store of more than a few blocks is cut into cells first, and a query meets only
the cells that can hold a hit (``operators.cells``).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.functions.vectors import is_finite
from logsift.operators.blocks import DIGITS, HIT_SCHEMA, best_in_block, matrix, tasks_for
from logsift.operators.cells import best_hits, partition
from logsift.operators.skew import join_unique
from logsift.staging import stage

# A task holds two blocks of this size, and their Arrow form at half of it. Larger
# blocks mean fewer copies of each row in the shuffle.
_BLOCK_BYTES = 256 << 20
_MIN_BLOCK = 512
_MAX_PIVOTS = 256
# Up to so many blocks, a full comparison costs less than cells.
_FEW_BLOCKS = 8
# Blocks of a given size grow up to these bytes while rows have more copies than this.
_GROWN_BYTES = 64 << 20
_COPIES = 8


def _block_rows(n_query: int, n_store: int, dim: int, parallelism: int) -> int:
    """Small enough for memory, and small enough that every core gets work."""
    fits = max(_MIN_BLOCK, _BLOCK_BYTES // (8 * max(1, dim)))
    spread = int(math.sqrt(n_query * n_store / max(1, 2 * parallelism)))
    return min(fits, max(_MIN_BLOCK, spread))


def _grown(block_rows: int, n_query: int, n_store: int, dim: int, parallelism: int) -> int:
    """Blocks of at least ``block_rows``, and larger ones where each row would be copied for very many blocks of the other side.

    A few copies give every core work; more of them only fill the disk. Memory bounds a block, and wins.
    """
    copies = max(_COPIES, math.isqrt(2 * parallelism))
    fits = max(_MIN_BLOCK, _GROWN_BYTES // (8 * max(1, dim)))
    return max(block_rows, min(fits, math.ceil(max(n_query, n_store) / copies)))


def _with_cells(df: DataFrame, vector: str, pivots: np.ndarray) -> DataFrame:
    """Nearest pivot of each row and the angle to it."""
    if len(pivots) <= 1:
        return df.withColumn("_cell", F.lit(0)).withColumn("_angle", F.lit(math.pi))

    def nearest(batches):
        for batch in batches:
            sims = np.clip(matrix(batch.column(batch.schema.get_field_index(vector))) @ pivots.T, -1.0, 1.0)
            cell = sims.argmax(axis=1)
            angle = np.arccos(sims[np.arange(len(cell)), cell])
            yield batch.append_column("_cell", pa.array(cell, pa.int32())).append_column(
                "_angle", pa.array(angle, pa.float64())
            )

    schema = T.StructType(list(df.schema.fields)).add("_cell", T.IntegerType()).add("_angle", T.DoubleType())
    return df.mapInArrow(nearest, schema)


def _dimension(store: DataFrame) -> int:
    row = store.select(F.size("svec").alias("dim")).first()
    return row["dim"] if row else 0


def _cell_stats(df: DataFrame, rows: int, pivots: int) -> dict[int, tuple[int, float]]:
    """Rows and radius per cell; at most one row per pivot reaches the driver."""
    if pivots <= 1:
        return {0: (rows, math.pi)}
    rows = df.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_angle").alias("r")).collect()
    return {row["_cell"]: (row["n"], row["r"]) for row in rows}


def _centres(store: DataFrame, rows: int, dim: int, block_rows: int, pivots: int | None) -> np.ndarray:
    """Vectors to measure angles from: an even choice of store rows, at most a few hundred."""
    if pivots is None:
        pivots = min(_MAX_PIVOTS, rows // (_FEW_BLOCKS * block_rows))
    if pivots <= 1:
        return np.zeros((1, dim))
    chosen = store.orderBy(F.xxhash64("sid"), "sid").limit(pivots).select("svec").toArrow()
    return matrix(chosen.column("svec"))


def top_matches(
    queries: DataFrame,
    store: DataFrame,
    k: int = 1,
    threshold: float | None = None,
    earlier_only: bool = False,
    block_rows: int | None = None,
    pivots: int | None = None,
) -> DataFrame:
    """``(qid, sid, sim, rank)``: the ``k`` most similar store rows of every query.

    ``queries`` has ``qid`` and ``qvec``, ``store`` has ``sid`` and ``svec``.
    ``threshold`` keeps hits with ``sim >= threshold``; ``earlier_only`` keeps
    those with ``sid < qid``. Both inputs are read more than once, so they
    should be stored tables. ``block_rows`` grows where rows would be copied for too many blocks. ``pivots`` above 1
    sets the number of cells, 1 compares all blocks.
    """
    spark = queries.sparkSession
    if _out_of_reach(threshold):
        return spark.createDataFrame([], HIT_SCHEMA + ", rank int")
    # A broken vector is similar to nothing, and must not hide others.
    queries = queries.select("qid", "qvec").where(is_finite(F.col("qvec")))
    store = store.select("sid", "svec").where(is_finite(F.col("svec")))
    n_query, n_store = queries.count(), store.count()
    if n_query == 0 or n_store == 0:
        return spark.createDataFrame([], HIT_SCHEMA + ", rank int")
    size = n_query, n_store, _dimension(store), spark.sparkContext.defaultParallelism
    block_rows = _block_rows(*size) if block_rows is None else _grown(block_rows, *size)
    if threshold is not None and threshold > 0:  # a zero vector has similarity 0 to everything
        queries, store = queries.where(_nonzero("qvec")), store.where(_nonzero("svec"))
    if (pivots or 0) > 1 or (pivots is None and n_store > _FEW_BLOCKS * block_rows):
        return partition(store, n_store, block_rows, pivots).search(queries, k, threshold, earlier_only)
    return best_hits(_compare_all(queries, store, n_query, n_store, k, threshold, earlier_only, block_rows), k)


def _compare_all(queries, store, n_query, n_store, k, threshold, earlier_only, block_rows) -> DataFrame:
    """The best ``k`` rows of each query in each block of the store: every pair of blocks meets."""
    n = {"q": math.ceil(n_query / block_rows), "s": math.ceil(n_store / block_rows)}

    def spread(df: DataFrame, own: str, other: str) -> DataFrame:
        block = F.pmod(F.xxhash64(f"{own}id"), F.lit(n[own])).cast("int")
        return df.withColumns({f"{own}b": block, f"{other}b": F.explode(F.sequence(F.lit(0), F.lit(n[other] - 1)))})

    def block(left_rows: pa.Table, right_rows: pa.Table) -> pa.Table:
        found = ([], [], [])
        if left_rows.num_rows and right_rows.num_rows:
            found = best_in_block(
                left_rows.column("qid").to_numpy(),
                matrix(left_rows.column("qvec")),
                right_rows.column("sid").to_numpy(),
                matrix(right_rows.column("svec")),
                k,
                threshold,
                earlier_only,
            )
        return pa.table(
            {
                "qid": pa.array(found[0], pa.int64()),
                "sid": pa.array(found[1], pa.int64()),
                "sim": pa.array(found[2], pa.float64()),
            }
        )

    keys, tasks = ["qb", "sb"], tasks_for(queries.sparkSession, n["q"] * n["s"])
    left, right = spread(queries, "q", "s").repartition(tasks, *keys), spread(store, "s", "q").repartition(tasks, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(block, HIT_SCHEMA)


def top_matches_once(queries: DataFrame, store: DataFrame, threshold: float, earlier_only: bool = False, **search) -> DataFrame:
    """``top_matches`` with ``k`` of 1, where equal query vectors are compared once.

    Of each distinct vector one row searches the whole store. Its best hit serves all copies, but with ``earlier_only``
    for copies that come no later than the hit: these few search again, each with its own place in the order.
    """
    if _out_of_reach(threshold):
        return queries.sparkSession.createDataFrame([], HIT_SCHEMA + ", rank int")
    queries = queries.select("qid", "qvec").where(_nonzero("qvec") if threshold > 0 else is_finite(F.col("qvec")))
    single = stage(queries.groupBy("qvec").agg(F.min("qid").alias("rep")), "distinct")
    found = top_matches(single.select(F.col("rep").alias("qid"), "qvec"), store, 1, threshold, False, **search)
    named = single.join(found.withColumnRenamed("qid", "rep"), "rep").select("qvec", "sid", "sim")
    hits = join_unique(queries, stage(named, "named"), "qvec").select("qid", "qvec", "sid", "sim")
    if not earlier_only:
        return hits.select("qid", "sid", "sim", F.lit(1).alias("rank"))
    hits = stage(hits, "hits")
    again = top_matches(hits.where("sid >= qid").select("qid", "qvec"), store, 1, threshold, True, **search)
    return hits.where("sid < qid").select("qid", "sid", "sim", F.lit(1).alias("rank")).unionByName(again)


def _out_of_reach(threshold: float | None) -> bool:
    """No similarity is above 1, rounded as they are, so no pair has to be compared."""
    return threshold is not None and threshold > 1


def _nonzero(vector: str) -> Column:
    return is_finite(F.col(vector)) & F.exists(vector, lambda x: x != 0)


def held_in_blocks(
    rows: DataFrame, threshold: float, block_rows: int | None = None, pivots: int | None = None
) -> DataFrame:
    """``qid`` of rows with an earlier row in their own block that reaches the threshold.

    A cheap first pass before all blocks meet: near copies share a cell, so
    nearly all of them are held back here, without copying any row.
    """
    spark = rows.sparkSession
    if _out_of_reach(threshold):
        return spark.createDataFrame([], "qid long")
    rows = rows.select("sid", "svec").where(_nonzero("svec")) if threshold > 0 else rows.select("sid", "svec")
    n_rows, dim = rows.count(), _dimension(rows)
    if block_rows is None:
        block_rows = _block_rows(n_rows, n_rows, dim, spark.sparkContext.defaultParallelism)
    centres = _centres(rows, n_rows, dim, block_rows, pivots if threshold > 0 else 1)
    celled = _with_cells(rows, "svec", centres)
    blocks = {cell: math.ceil(n / block_rows) for cell, (n, _) in _cell_stats(celled, n_rows, len(centres)).items()}
    if len(centres) <= 1:
        placed = celled.withColumn("_n", F.lit(max(1, blocks[0])))
    else:
        table = spark.createDataFrame(list(blocks.items()), "_cell int, _n int")
        placed = celled.join(F.broadcast(table), "_cell")  # a row per pivot
    salted = placed.withColumn("_block", F.pmod(F.xxhash64("sid"), F.col("_n")))

    def block(table: pa.Table) -> pa.Table:
        ids, units = table.column("sid").to_numpy(), matrix(table.column("svec"))
        held, _, _ = best_in_block(ids, units, ids, units, 1, threshold, True)
        return pa.table({"qid": pa.array(held, pa.int64())})

    tasks = tasks_for(spark, sum(blocks.values()))
    return salted.repartition(tasks, "_cell", "_block").groupBy("_cell", "_block").applyInArrow(block, "qid long")


def search_batch(queries: DataFrame, store: DataFrame, k: int = 1, **options) -> DataFrame:
    """``(qid, hits)`` for every query; ``hits`` is empty where the store has none.

    ``store`` has the columns of the vector store. Only the k rows per query
    fetch their stored fields.
    """
    keyed = store.select(F.col("id").alias("sid"), F.col("vector").alias("svec"))
    found = top_matches(queries, keyed, k=k, **options)
    fields = store.select(
        F.col("id").alias("sid"),
        F.struct("raw_text", "is_error", "model_name", "embedder_model_name").alias("entity"),
    )
    hit = F.struct(
        F.col("rank"), F.col("sid").alias("id"), F.col("sim").alias("distance"), F.col("entity")
    )
    lists = (
        join_unique(found, fields, "sid")
        .groupBy("qid")
        .agg(F.sort_array(F.collect_list(hit)).alias("_hits"))
        .withColumn("hits", F.transform("_hits", lambda h: h.dropFields("rank")))
        .drop("_hits")
    )
    empty = F.array().cast(lists.schema["hits"].dataType)
    return queries.select("qid").join(lists, "qid", "left").withColumn("hits", F.coalesce("hits", empty))


def search(vector: list[float], store: DataFrame, k: int = 1) -> DataFrame:
    """The hits of a single vector as rows, best first; no rows if there are none."""
    spark = store.sparkSession
    query = spark.createDataFrame([(0, [float(x) for x in vector])], "qid long, qvec array<double>")
    found = search_batch(query, store, k=k)
    return found.select(F.posexplode("hits").alias("rank", "hit")).select(
        (F.col("rank") + 1).alias("rank"), "hit.*"
    )
