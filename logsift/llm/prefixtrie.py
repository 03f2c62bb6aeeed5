"""Prefix trie of conversations by range minima over sorted common prefixes.

Every turn gets a name (MD5 of role and text), a conversation is the sequence of its turns'
names, equal sequences are one class. Classes are sorted by their sequence in one range shuffle, and
each gets the length of the prefix it shares with the class before it (LCP). The conversations that
start with a given prefix are an interval of this order, bounded where the LCP falls below
the prefix's depth.

A range of the order is one group of bounded size. It holds a sparse table: minima of the LCPs over
all spans of 2^k classes. Each candidate prefix, a class and a depth, binary-searches its left
and its right extent in that table, independently of all others. An extent that reaches the
edge of the range is searched on in a second sparse table over whole ranges, of which there are at most
65,536: the first range names the node, and its pieces in the other ranges are added up by that name. No stack
and no tree is kept, so memory depends on the size of a range alone.

What a node says of its subtree comes from sums over its interval: members, childless nodes, and saved
bytes as ``sum of (members - 1) * bytes of the last turn``.

Cases: rows without a conversation are left out. Turns come by ``turn``, null first, equal ones by their name; null
roles and texts count as empty. Repeated rows are repeated turns. A conversation without turns ends at the
root. An empty table has no node. Other columns are ignored. The turns of one conversation are held together,
as names of 16 bytes; texts are not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.common import attach
from logsift.llm.ranges import in_ranges
from logsift.staging import scratch_path, stage, stage_at, temporary_stages

CLASSES_PER_RANGE = 20_000
# Span of ids whose decimal texts are joined in one piece of a digest; thousands of pieces travel in one batch.
IDS_PER_PIECE = 512


def turns_of(rows: DataFrame) -> DataFrame:
    """``conv_id, turns``: names and text bytes of the turns in order; ``rows``: conv_id, turn, role, text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    name = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    cells = rows.filter("conv_id IS NOT NULL").select("conv_id", F.struct("turn", name.alias("name"), F.octet_length(text).cast("long").alias("bytes")).alias("cell"))
    order = cells.groupBy("conv_id").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    return order.select("conv_id", F.transform("cells", lambda c: F.struct(c["name"].alias("name"), c["bytes"].alias("bytes"))).alias("turns"))


def sorted_classes(conversations: DataFrame, classes_per_range: int) -> DataFrame:
    """Distinct sequences in order: ``class, range, place, lcp, bytes, members, conv_id``; a written table.

    ``lcp`` of the first class of a range counts from the last class of the range before, and is -1 for the very first.
    """
    spark = conversations.sparkSession
    out = scratch_path(spark, "trie")
    with temporary_stages(spark):
        facts = conversations.groupBy("names").agg(F.count("*").alias("members"), F.min("conv_id").alias("conv_id"), F.first("class").alias("class"), F.first("bytes").alias("bytes"))
        ranged = in_ranges(stage(facts, "classes"), ["names"], classes_per_range)
        order = Window.partitionBy("range").orderBy("names")
        edges = ranged.groupBy("range").agg(F.min("names").alias("first"), F.max("names").alias("last"))
        edges = stage(edges, "edges")
        # One row per range, of which there are at most 65,536.
        ahead = edges.select("range", F.lag("last").over(Window.orderBy("range")).alias("edge"))
        known = ranged.withColumns({"place": F.row_number().over(order) - 1, "before": F.lag("names").over(order)})
        known = known.join(ahead, "range").withColumn("before", F.when(F.col("place") == 0, F.col("edge")).otherwise(F.col("before")))
        found = known.select("class", "range", F.col("place").cast("long"), _common("before", "names").alias("lcp"), "bytes", "members", "conv_id")
        return stage_at(found, out)


def _common(left: str, right: str) -> Column:
    """Length of the common prefix of two arrays; -1 if the left one is null."""
    both = F.least(F.size(left), F.size(right))
    differs = F.filter(F.sequence(F.lit(1), both), lambda i: F.get(F.col(left), i - 1) != F.get(F.col(right), i - 1))
    found = F.when(both > 0, F.coalesce(F.array_min(differs) - 1, both)).otherwise(0)
    return F.when(F.col(left).isNull(), -1).otherwise(found).cast("long")


class SparseTable:
    """Minima over all spans of 2^k neighbours; ``lowest`` level first."""

    def __init__(self, values: np.ndarray):
        self.levels = [np.asarray(values, np.int64)]
        while len(self.levels[-1]) > (half := 1 << (len(self.levels) - 1)):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def left(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Smallest ``l`` such that all values in (l, at] are at least ``depth``; value ``i`` stands between ``i - 1`` and ``i``."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            start = at - (1 << k) + 1
            inside = start >= 1
            at -= (inside & (self.levels[k][np.where(inside, start, 0)] >= depth)).astype(np.int64) << k
        return at

    def right(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Largest ``r`` such that all values in (at, r] are at least ``depth``."""
        at, size = at.copy(), len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            inside = at + (1 << k) < size
            at += (inside & (self.levels[k][np.where(inside, at + 1, 0)] >= depth)).astype(np.int64) << k
        return at

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum over [first, last]."""
        k = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), np.int64)
        for level in np.unique(k):
            rows = np.flatnonzero(k == level)
            values = self.levels[level]
            out[rows] = np.minimum(values[first[rows]], values[last[rows] - (1 << level) + 1])
        return out


PIECES = (
    "home long, depth long, open boolean, starts boolean, class string, left_range long, left_place long, right_range long, right_place long, conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved long, parent_home long, parent_conv_id long"
)


def pieces_of(rows: pd.DataFrame, low: np.ndarray, bounds: np.ndarray) -> pd.DataFrame:
    """Nodes of one range. ``low``: least LCP of each range with its first one; ``bounds``: the first LCPs alone, by number of the range.

    A piece is ``open`` if its node reaches over an edge of the range; ``home`` is then the range where the node starts.
    """
    rows = rows.sort_values("place")
    number = int(rows["range"].iloc[0])
    lcp, members, ids = (rows[c].to_numpy(np.int64) for c in ("lcp", "members", "conv_id"))
    size = np.array([len(b) for b in rows["bytes"]], np.int64)
    # Bytes of the first d turns stand at offset[i] + d.
    offset = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    flat = np.zeros(int((size + 1).sum()), np.int64)
    if size.sum():
        flat[np.delete(np.arange(len(flat)), offset)] = np.concatenate([np.asarray(b, np.int64) for b in rows["bytes"] if len(b)])
    upto = np.cumsum(flat) - np.repeat(np.cumsum(flat)[offset], size + 1)
    total = upto[offset + size]
    after = bounds[number + 1] if number + 1 < len(bounds) else -1
    following = np.append(lcp[1:], after)
    leaf = (following < size).astype(np.int64)
    new = total - upto[offset + np.maximum(lcp, 0)]  # bytes of the nodes that start at a class, but for a first one's
    sums = [np.concatenate([[0], np.cumsum(v)]) for v in (members, members * total, new, leaf)]

    inner = lcp.copy()
    inner[0] = -1  # what lies before the range is searched for in the other table
    table, ranges, least_id = SparseTable(inner), SparseTable(low), SparseTable(ids)
    at = np.repeat(np.arange(len(size)), size + 1)
    depth = np.arange(len(at)) - np.repeat(offset, size + 1)
    left, right = table.left(at, depth), table.right(at, depth)
    # One candidate of each piece: the one at its left end.
    key = np.flatnonzero(left == at)
    at, depth, right = at[key], depth[key], right[key]
    open_left = (at == 0) & (lcp[0] >= depth)
    open_right = (right == len(size) - 1) & (after >= depth)
    home = np.full(len(at), number, np.int64)
    if open_left.any():
        back = np.full(int(open_left.sum()), number - 1)
        home[open_left] = ranges.left(back, depth[open_left])
    n, weighted, fresh, leaves = (s[right + 1] - s[at] for s in sums)
    mine = upto[offset[at] + np.maximum(depth - 1, 0)]
    # The first class counts all nodes from this one down, unless the node starts in an earlier range.
    fresh += np.where(open_left, 0, total[at] - mine - new[at])
    first_id = least_id.least(at, right)
    is_open = open_left | open_right

    # A node is a child of the piece one turn shorter that covers its start; pieces are in order of place and depth.
    child = np.flatnonzero(~open_left & (depth > 0))
    longest = int(size.max()) + 1
    parent = np.searchsorted(at * longest + depth, table.left(at[child], depth[child] - 1) * longest + depth[child] - 1)
    parent_home, parent_id = np.full(len(at), -1, np.int64), np.full(len(at), None, object)
    parent_home[child] = np.where(is_open[parent], home[parent], -1)
    parent_id[child] = np.where(is_open[parent], None, first_id[parent])
    ends = (size[at] == depth) & ~open_left
    return pd.DataFrame(
        {
            "home": home, "depth": depth, "open": is_open, "starts": ~open_left, "class": np.where(ends, rows["class"].to_numpy()[at], None),
            "left_range": number, "left_place": at, "right_range": number, "right_place": right, "conv_id": first_id, "n_convs": n,
            "n_children": np.bincount(parent, minlength=len(at)), "n_leaves": leaves, "saved": weighted - n * mine - fresh,
            "parent_home": parent_home, "parent_conv_id": pd.Series(parent_id, dtype="Int64"),
        }
    )


def _edges(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Per range the least LCP, its first one included, and the first LCP of the next filled range at or after it.

    Numbers of at most 65,536 ranges. An empty range lets every search pass.
    """
    edges = classes.groupBy("range").agg(F.min("lcp").alias("low"), F.max(F.when(F.col("place") == 0, F.col("lcp"))).alias("bound"))
    known = {r["range"]: r for r in edges.collect()}
    last = max(known, default=-1)
    low, bounds = np.full(last + 1, np.iinfo(np.int64).max), np.full(last + 2, -1, np.int64)
    for i in range(last, -1, -1):
        bounds[i] = known[i].bound if i in known else bounds[i + 1]
        if i in known:
            low[i] = known[i].low
    return low, bounds


def nodes(conversations: DataFrame, classes_per_range: int = CLASSES_PER_RANGE) -> DataFrame:
    """One row per distinct prefix of ``conversations`` (``conv_id, turns``).

    Gives the member interval (``left_range, left_place, right_range, right_place`` in the sorted classes), ``class``
    of the sequence that ends there or null, ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``.
    """
    classes = sorted_classes(with_class(conversations), classes_per_range)
    low, bounds = _edges(classes)

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        return pieces_of(rows, low, bounds)

    pieces = stage(classes.groupBy("range").applyInPandas(cut, PIECES), "pieces")
    start = F.min(F.when(F.col("starts"), F.struct("left_range", "left_place", "class", "parent_home", "parent_conv_id"))).alias("start")
    end = F.max(F.struct("right_range", "right_place")).alias("end")
    counts = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    merged = pieces.filter("open").groupBy("home", "depth").agg(start, end, F.min("conv_id").alias("conv_id"), *counts)
    merged = stage(merged.select("home", "depth", "start.*", "end.*", "conv_id", "n_convs", "n_children", "n_leaves", "saved"), "open")
    every = pieces.filter("NOT open").drop("open", "starts").unionByName(merged)
    parents = merged.select(F.concat_ws("-", "home", F.col("depth") + 1).alias("_parent"), F.col("conv_id").alias("_id"))
    inside = every.filter("parent_home < 0")
    below = every.filter("parent_home >= 0").withColumn("_parent", F.concat_ws("-", "parent_home", "depth"))
    below = attach(below, "_parent", parents, 64, "inner").withColumn("parent_conv_id", F.col("_id")).drop("_parent", "_id")
    return inside.unionByName(below).select(
        "left_range", "left_place", "right_range", "right_place", "class", "conv_id", "depth", "parent_conv_id",
        "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
    )


def with_class(conversations: DataFrame) -> DataFrame:
    """``conv_id, names, bytes, class``: the class is a digest of the sequence."""
    split = conversations.select("conv_id", F.col("turns.name").alias("names"), F.col("turns.bytes").alias("bytes"))
    return split.withColumn("class", F.md5(F.array_join(F.transform("names", F.hex), "").cast("binary")))


def id_digests(conversations: DataFrame) -> DataFrame:
    """``class, ends_sha256``: SHA-256 of the decimal ids of a class, ascending, joined by commas.

    Ids are joined in pieces of a bounded span of ids; a task then reads the pieces of a class in order
    and feeds them to one running digest, so it holds one piece, however large the class.
    """
    piece = F.floor(F.col("conv_id") / IDS_PER_PIECE)
    ids = with_class(conversations).groupBy("class", piece.alias("piece")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    texts = ids.select("class", "piece", F.array_join("ids", ",").alias("text"))

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            done = []
            for name, text in zip(batch["class"], batch["text"], strict=True):
                if name != now:
                    if state:
                        done.append((now, state.hexdigest()))
                    now, state = name, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield pd.DataFrame(done, columns=["class", "ends_sha256"])
        if state:
            yield pd.DataFrame([(now, state.hexdigest())], columns=["class", "ends_sha256"])

    ordered = texts.repartition("class").sortWithinPartitions("class", "piece")
    return ordered.select("class", "text").mapInPandas(digests, "class string, ends_sha256 string")
