"""Connected components by alternating large-star and small-star.

Every round rewires each node to the smallest node it knows, first over its
larger neighbours, then over its smaller ones, until only stars are left. A
node's minimum is combined before the shuffle and written, so that the join
back to the edges of a node with very many neighbours can be split by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.staging import scratch_path, stage, stage_at, temporary_stages


def _with_minimum(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(stage(least.withColumn("m", F.least("u", "m")), "minimum"), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_minimum(both).filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` lead from the larger node to the smaller."""
    known = _with_minimum(edges)
    moved = known.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(known.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node but the smallest of each component.

    ``edges`` has columns ``u`` and ``v`` in any order, with repeats and loops.
    The component is named by its smallest node. Null ends link nothing. The
    result is a written table.
    """
    spark = edges.sparkSession
    out = scratch_path(spark, "components")
    with temporary_stages(spark):
        ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), (F.col("u") == F.col("v")).alias("loop"))
        now = stage(ordered.filter("NOT loop").select("u", "v").distinct(), "edges")
        last = None
        while True:
            mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
            if mark == last:
                break
            last = mark
            now = stage(_small_star(stage(_large_star(now), "edges")), "edges")
        return stage_at(now.select(F.col("u").alias("node"), F.col("v").alias("component")), out)
