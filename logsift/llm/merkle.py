"""Merkle manifest of a dataset: one tree per group, one tree over the groups' roots.

A row is a leaf: the SHA-256 of its columns, each written as ``-`` if null and as
``bytes:value`` otherwise. The leaves of a group ascend by their order column; every ``ARITY``
consecutive nodes become one, until one is left, the group's subroot. The subroots, ordered by
group, become the root in the same way.

Only every ``STRIDE``-th level is written (checkpoint); the levels between are recomputed.
A stored node and its ``ARITY ** STRIDE`` stored descendants form an aligned subtree, whose rows
come together in one task: once to find the node above, and once more to extract proofs, where the
interior nodes are regenerated from the stored descendants, their siblings are handed down to the
descendants, and the nodes are discarded. A row of the plan holds at most 512 stored nodes,
whatever the size of a group.

Leaves get their places by one range shuffle of digests; text is read once and never moves. Ranges
are numbered inside their group by running counts, so a group with most of the rows is spread over
many tasks, and so are the rows of one identifier.

Cases: a null group is a group of its own, before all others; null order values come first. Rows
with equal order value ascend by their leaf, and wholly equal rows are leaves of their own. A single
leaf is its own subroot, a single subroot the root; both have no sibling there. An empty table has
no leaf and no root. Columns that are not hashed are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.ranges import in_ranges
from logsift.staging import scratch_path, stage, stage_at, temporary_stages

ARITY = 8
STRIDE = 3
ROWS_PER_RANGE = 250_000


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of joined texts."""
    return F.sha2(F.concat(*parts), 256)


def leaf(*columns: Column) -> Column:
    """Digest of a row: per column ``-`` for null, else byte count, colon and value."""
    texts = [c.cast("string") for c in columns]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def joined(path: Column) -> Column:
    """Digest of all siblings of a path, from the leaf upwards, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda node, p: digest(p["before"], node, p["after"]))


def _height(n: str) -> Column:
    """Levels above ``n`` leaves, by comparing integers."""
    found = F.lit(0)
    for k in range(1, 22):  # 8 ** 21 exceeds every long
        found = F.when(F.col(n) > ARITY ** (k - 1), k).otherwise(found)
    return found


def _placed(rows: DataFrame, rows_per_range: int) -> DataFrame:
    """Level 0 as a written table: ``rows`` (``tree, order, hash, row``) with ``at``, the place inside the tree, and ``height``."""
    spark = rows.sparkSession
    out = scratch_path(spark, "merkle-0")
    with temporary_stages(spark):
        ranged = in_ranges(stage(rows, "leaves"), ["tree", "order", "hash"], rows_per_range)
        counts = stage(ranged.groupBy("tree", "range").agg(F.count("*").alias("n")), "counts")
        before = Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
        sizes = counts.groupBy("tree").agg(F.sum("n").alias("n")).select("tree", _height("n").alias("height"))
        inside = Window.partitionBy("tree", "range").orderBy("order", "hash", "tie")
        numbered = ranged.withColumn("place", F.row_number().over(inside) - 1).join(starts.join(sizes, "tree"), ["tree", "range"])
        return stage_at(numbered.select("tree", "height", (F.col("start") + F.col("place")).alias("at"), "hash", "row"), out)


def _subtrees(stored: DataFrame, level: int, keep: list[str]) -> DataFrame:
    """The node above each aligned subtree of the stored ``level``; its descendants are nested in ``children``.

    All rows of a subtree are in one task after the first exchange. At the top of its tree a node stays
    what it is: it is not hashed again.
    """
    nodes = stored.withColumn("block", F.floor(F.col("at") / ARITY**STRIDE)).repartition("tree", "block")
    for k in range(STRIDE):
        child = F.struct("at", "hash", *(keep if k == 0 else ["children"]))
        runs = nodes.groupBy("tree", "block", "height", F.floor(F.col("at") / ARITY).alias("at"))
        runs = runs.agg(F.sort_array(F.collect_list(child)).alias("children"))
        above = F.sha2(F.array_join(F.transform("children", lambda c: c["hash"]), ""), 256)
        nodes = runs.withColumn("hash", F.when(F.col("height") > level + k, above).otherwise(F.get("children", F.lit(0))["hash"]))
    return nodes


def _handed_down(nodes: DataFrame, level: int, keep: list[str], carried: tuple[str, ...]) -> DataFrame:
    """The children of ``nodes``, nodes of ``level``, with their siblings before their parent's ``path``."""
    hashes = F.transform("children", lambda c: c["hash"])
    rows = nodes.select("tree", "block", "height", "path", *carried, hashes.alias("hashes"), F.posexplode("children").alias("i", "child"))
    before = F.array_join(F.slice("hashes", F.lit(1), F.col("i")), "")
    after = F.array_join(F.slice("hashes", F.col("i") + 2, F.lit(ARITY)), "")
    own = F.array(F.struct(before.alias("before"), after.alias("after")))
    path = F.when(F.col("height") > level, F.concat(own, "path")).otherwise(F.col("path"))
    return rows.select("tree", "block", "height", path.alias("path"), *carried, *[F.col(f"child.{c}").alias(c) for c in ["at", "hash", *keep]])


@dataclass(frozen=True)
class Forest:
    """Written levels of trees: ``stored[k]`` has level ``k * STRIDE`` as ``tree, height, at, hash``, level 0 also ``row``."""

    stored: list[DataFrame]

    def tops(self) -> DataFrame:
        """``tree, hash`` of each tree's top."""
        return self.stored[-1].select("tree", "hash")

    def paths(self, above: DataFrame, *carried: str) -> DataFrame:
        """``row, hash, path`` of every leaf and what ``above`` has for its tree: ``tree, path``, the path from the top upwards, and ``carried``.

        The written levels are walked downwards; only paths of stored nodes above the leaves are written.
        """
        known = self.stored[-1].join(above, "tree")
        for depth in range(len(self.stored) - 2, -1, -1):
            known = stage(known.select("tree", F.col("at").alias("block"), "path", *carried), "paths")
            keep = ["row"] if depth == 0 else []
            nodes = _subtrees(self.stored[depth], depth * STRIDE, keep).drop("at", "hash").join(known, ["tree", "block"])
            for k in range(STRIDE - 1, -1, -1):
                nodes = _handed_down(nodes, depth * STRIDE + k, keep if k == 0 else ["children"], carried)
            known = nodes
        return known.select("row", "hash", "path", *carried)


def grow(rows: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> Forest:
    """The stored levels over ``rows``: ``tree`` (never null), ``order``, ``hash``, ``row``."""
    stored = [_placed(rows, rows_per_range)]
    tallest, level = stored[0].agg(F.max("height")).first()[0] or 0, 0
    while level < tallest:
        above = _subtrees(stored[-1], level, []).select("tree", "height", F.col("block").alias("at"), "hash")
        level += STRIDE
        stored.append(stage(above, f"merkle-{level}"))
    return Forest(stored)


@dataclass(frozen=True)
class Manifest:
    """A forest with a tree per group, and the tree over its subroots."""

    groups: Forest
    top: Forest

    def root(self) -> DataFrame:
        """One row ``root``; none for an empty table."""
        return self.top.tops().select(F.col("hash").alias("root"))

    def proofs(self) -> DataFrame:
        """Per leaf ``row, leaf, subroot, root, path``, the path leading to the root."""
        nothing = F.array().cast("array<struct<before:string,after:string>>").alias("path")
        roots = self.top.tops().select("tree", nothing, F.col("hash").alias("root"))
        above = self.top.paths(roots, "root").select(F.col("row").alias("tree"), F.col("hash").alias("subroot"), "path", "root")
        found = self.groups.paths(stage(above, "subroots"), "subroot", "root")
        return found.select("row", F.col("hash").alias("leaf"), "subroot", "root", "path")


def build(leaves: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> Manifest:
    """The manifest of ``leaves``: ``group, order, hash`` and ``row``, which proofs carry along."""
    tree = F.when(F.col("group").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("group").cast("string")))
    groups = grow(leaves.select(tree.alias("tree"), "order", "hash", "row"), rows_per_range)
    subroots = groups.tops().select(F.lit("").alias("tree"), F.col("tree").alias("order"), "hash", F.col("tree").alias("row"))
    return Manifest(groups, grow(subroots, rows_per_range))
