"""Mixes sources to target weights, exact to the word.

Sources in code point order (null last) weigh 1, 2, 3, repeating, and share the words of the
corpus; no target exceeds three times its source, and the excess is shared again by weight.
In that fixed point all sources below their limit have the same words per weight, a level
that running sums over the sources give at once. Documents are ordered by the
MD5 of their id inside their source. The hash splits a source into ranges of about
``rows_per_range`` documents: totals of the ranges are summed up first, then each range
on its own, so a source with a third of all rows is spread like any other and nothing is
sorted globally. A source takes whole epochs, then its documents in order up to
the exact budget, the last one in part.

Cases: a null or blank text has size 0 and takes 0. A corpus without words has targets of 0.
A null source is one source, the empty name another. Rows equal in source, ``doc_id`` and size are taken one
after the other; a null ``doc_id`` is hashed as the empty text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.common import WORD, attach
from logsift.staging import scratch_path, stage, stage_at, temporary_stages

ROWS_PER_RANGE = 20_000
MOST_EPOCHS = 3
WEIGHTS = (1, 2, 3)
_ORDER = "_order"


def _source_key() -> Column:
    """Never null; sorts like the source with null last."""
    return F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source: ``_source, source_size, target``; ``sizes`` has ``_source, size``."""
    per = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(Window.orderBy("_source")) - 1) % len(WEIGHTS))
    per = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * MOST_EPOCHS)
    order = Window.orderBy(F.col("most") / F.col("weight"), "_source")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sharing = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = per.withColumn("level", left / sharing).withColumn("place", F.row_number().over(order))
    # The first source that its share does not fill sets the level of all from there on.
    fits = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("place", "level"))).over(everything)
    return level.withColumn("fit", fits).select(
        "_source", "source_size", F.least(F.col("most").cast("double"), F.col("fit.level") * F.col("weight")).alias("target")
    )


def plan(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """What is taken of each ``(_source, doc_id, size)``: its ``copies`` and the words ``before`` them; a written table."""
    spark = docs.sparkSession
    out = scratch_path(spark, "mix")
    with temporary_stages(spark):
        sizes = docs.select("doc_id", _source_key().alias("_source"), _size().alias("size"))
        sizes = stage(sizes.groupBy("_source", "doc_id", "size").agg(F.count("*").alias("copies")), "sizes")
        totals = stage(targets(sizes.select("_source", (F.col("size") * F.col("copies")).alias("size"))), "targets")
        digits = math.ceil(math.log(max(1, sizes.count() / rows_per_range), 16))
        draw = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
        drawn = sizes.withColumn("draw", draw).withColumn("range", F.substring("draw", 1, digits))
        words = F.col("size") * F.col("copies")
        running = Window.partitionBy("_source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        ranges = drawn.groupBy("_source", "range").agg(F.sum(words).alias("words"))
        ranges = ranges.select("_source", "range", F.coalesce(F.sum("words").over(running), F.lit(0)).alias("start"))
        inside = Window.partitionBy("_source", "range").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
        placed = drawn.withColumn("inside", F.coalesce(F.sum(words).over(inside), F.lit(0)))
        placed = placed.join(ranges, ["_source", "range"]).withColumn("before", F.col("start") + F.col("inside"))
        placed = attach(placed.select("_source", "doc_id", "size", "copies", "before"), "_source", totals, 128, "inner")
        return stage_at(placed, out)


def _taken(number: Column) -> Column:
    """Words taken of the ``number``-th of equal rows."""
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size") - F.col("before") - number * F.col("size")
    return (epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))).cast("long")


def mix(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``."""
    rows = plan(docs, rows_per_range).withColumn("number", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return rows.select("doc_id", "size", "source_size", "target", _taken(F.col("number")).alias("taken"))


def mixed_rows(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """The rows of ``docs`` of which words are taken, with ``size``, ``source_size``, ``target`` and ``taken``.

    Rows equal in source, id and size are numbered; only those meet in one task.
    """
    key = ["_source", "_id", "size"]
    decided = plan(docs, rows_per_range).withColumn("_id", F.coalesce("doc_id", F.lit(0))).withColumn("_none", F.col("doc_id").isNull()).drop("doc_id")
    facts = docs.withColumns({"_source": _source_key(), "_id": F.coalesce("doc_id", F.lit(0)), "_none": F.col("doc_id").isNull(), "size": _size()})
    joined = facts.join(decided, [*key, "_none"])
    numbered = Window.partitionBy(*key, "_none").orderBy(F.xxhash64("text"))
    once = joined.filter("copies = 1").withColumn(_ORDER, F.lit(0))
    more = joined.filter("copies > 1").withColumn(_ORDER, F.row_number().over(numbered) - 1)
    rows = once.unionByName(more).withColumn("taken", _taken(F.col(_ORDER)))
    return rows.filter("taken > 0").drop("_source", "_id", "_none", "copies", "before", _ORDER)
