"""The Merkle manifest and the prefix trie against plain Python, over ranges of a few rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsift.llm import merkle, prefixtrie


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    path = []
    for level in levels[:-1]:
        run = range(i // 8 * 8, min(i // 8 * 8 + 8, len(level)))
        path.append(("".join(level[j] for j in run if j < i), "".join(level[j] for j in run if j > i)))
        i //= 8
    return path


def brute_manifest(rows):
    """Sorted (group, order, leaf, subroot, path) and the root."""
    trees, out = {}, []
    for group, order, leaf in rows:
        trees.setdefault(group, []).append((order is not None, order or 0, leaf))
    groups = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: levels_of([x[2] for x in sorted(trees[g])]) for g in groups}
    top = levels_of([built[g][-1][0] for g in groups])
    for k, g in enumerate(groups):
        for i, (there, order, leaf) in enumerate(sorted(trees[g])):
            out.append((g, order if there else None, leaf, built[g][-1][0], siblings(built[g], i) + siblings(top, k)))
    return sorted(out, key=repr), top[-1][0]


@pytest.mark.parametrize("rows_per_range", [7, 1000])
def test_manifest(spark, rows_per_range):
    draw = random.Random(5)
    # A group of most rows, lone groups, a null group, null and repeated orders, wholly equal rows.
    rows = [("big", i, f"t{i}") for i in range(600)] + [("big", None, "n"), ("big", 7, "t7"), ("big", 7, "other")] + [("same", 1, "x")] * 80
    rows += [(f"g{k}", 1, "one") for k in range(70)] + [(None, 2, "null group"), (None, 1, None), ("", 1, ""), ("ü", 1, "ü"), ("z" * 3000, 1, "z")]
    rows += [("nine", k, None) for k in range(9)] + [("eight", k, "e") for k in range(8)]
    draw.shuffle(rows)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "g string, o long, text string, tree string, at int").repartition(5)
    leaves = df.select(F.col("g").alias("group"), F.col("o").alias("order"), merkle.leaf(F.col("o"), F.col("text")).alias("hash"), F.struct("g", "o").alias("row"))
    manifest = merkle.build(leaves, rows_per_range)
    cell = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    want, root = brute_manifest([(g, o, sha(cell(o), cell(t))) for g, o, t in rows])
    proofs = manifest.proofs()
    found = proofs.select("row.*", "leaf", "subroot", "path", "root", merkle.folded(F.col("leaf"), F.col("path")).alias("folded"), merkle.joined(F.col("path")).alias("joined")).collect()
    assert [r.root for r in manifest.root().collect()] == [root]
    assert {(r.root, r.folded) for r in found} == {(root, root)}
    assert sorted(((r.g, r.o, r.leaf, r.subroot, [tuple(p) for p in r.path]) for r in found), key=repr) == want
    assert all(r.joined == sha(*[x for p in r.path for x in p]) for r in found)
    # Stored are only every third level and one top per tree.
    assert [s.count() for s in manifest.groups.stored][1] == 78 + 1  # 603 leaves need two nodes of level 3


def test_manifest_of_nothing_and_of_one(spark):
    empty = spark.createDataFrame([], "group string, order long, hash string, row long")
    assert merkle.build(empty).root().count() == 0 and merkle.build(empty).proofs().count() == 0
    one = merkle.build(spark.createDataFrame([(None, None, "h", 1)], empty.schema)).proofs().first()
    assert (one.leaf, one.subroot, one.root, one.path) == ("h", "h", "h", [])


def test_any_change_is_found(spark):
    rows = spark.range(100).select(F.lit("g").alias("group"), F.col("id").alias("order"), merkle.leaf(F.col("id")).alias("hash"), F.col("id").alias("row"))
    proofs = merkle.build(rows, 10).proofs()
    changed = merkle.folded(F.when(F.col("row") % 2 == 0, merkle.leaf(F.col("row") + 1)).otherwise(F.col("leaf")), F.col("path"))
    assert {(r.row % 2, r.ok) for r in proofs.select("row", (changed == F.col("root")).alias("ok")).collect()} == {(0, False), (1, True)}


def brute_trie(conversations):
    nodes = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[: len(prefix)] == prefix]
        children = [p for p in below if len(p) == len(prefix) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        parent = min(nodes[prefix[:-1]]) if prefix else None
        ends = ",".join(str(c) for c in sorted(members) if len(conversations[c]) == len(prefix))
        out.add((min(members), len(prefix), parent, len(members), len(children), len(leaves), saved, sha(ends) if ends else None))
    return out


def found_trie(conversations, classes_per_range):
    nodes = prefixtrie.nodes(conversations, classes_per_range)
    digests = prefixtrie.id_digests(conversations)
    rows = nodes.join(digests, "class", "left").collect()
    places = {(r.left_range, r.left_place, r.right_range, r.right_place, r.depth) for r in rows}
    assert len(places) == len(rows)
    return {(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}, len(rows)


@pytest.mark.parametrize("classes_per_range, letters", [(3, 2), (8, 3), (1000, 2), (1, 2)])
def test_trie_over_ranges_of_any_size(spark, classes_per_range, letters):
    draw = random.Random(classes_per_range)
    turns = {c: [("user", draw.choice(["a", "bb", "üü"][:letters])) for _ in range(draw.choice([0, 1, 2, 5, 9]))] for c in range(-20, 160)}
    turns |= {c: [("user", "hot"), ("assistant", "x")] for c in range(1000, 1100)} | {c: [("user", "hot")] for c in range(1100, 1110)}
    turns[5000] = [("user", "a")] * 300
    turns[2**63 - 1] = [("user", "last")]
    rows = [(c, i, r, t) for c, ts in turns.items() for i, (r, t) in enumerate(ts)]
    held = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    named = prefixtrie.turns_of(held)
    empty = [(c,) for c, ts in turns.items() if not ts]
    named = named.unionByName(spark.createDataFrame(empty, "conv_id long").withColumn("turns", F.expr(f"cast(array() as {named.schema['turns'].dataType.simpleString()})")))
    found, n = found_trie(named, classes_per_range)
    want = brute_trie(turns)
    assert n == len({tuple(ts[:d]) for ts in turns.values() for d in range(len(ts) + 1)}) and found == want


def test_trie_of_odd_rows(spark):
    schema = "conv_id long, turn int, role string, text string, class string, names int"
    rows = [(None, 1, "user", "x", "c", 1), (1, 2, "user", "b", "c", 1), (1, None, None, None, None, None), (2, None, "", "", "d", 2), (2, 2, "user", "b", None, 1), (3, 5, None, "", None, None)]
    found, _ = found_trie(prefixtrie.turns_of(spark.createDataFrame(rows, schema)), 2)
    assert found == brute_trie({1: [("", ""), ("user", "b")], 2: [("", ""), ("user", "b")], 3: [("", "")]})
    assert found_trie(prefixtrie.turns_of(spark.createDataFrame([], schema)), 2) == (set(), 0)


def test_sparse_table_searches(spark):
    values = np.random.default_rng(3).integers(0, 6, 57)
    table = prefixtrie.SparseTable(values)
    at, depth = np.repeat(np.arange(57), 7), np.tile(np.arange(7), 57)
    for i, d, l, r in zip(at, depth, table.left(at, depth), table.right(at, depth), strict=True):  # noqa: E741
        a = b = i
        while a >= 1 and values[a] >= d:
            a -= 1
        while b + 1 < 57 and values[b + 1] >= d:
            b += 1
        assert (l, r) == (a, b)
    first, last = np.triu_indices(57)
    assert (table.least(first, last) == [values[a : b + 1].min() for a, b in zip(first, last, strict=True)]).all()
