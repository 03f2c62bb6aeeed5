"""Operators over documents against plain Python, with null, empty, long, repeated and clashing input."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from logsift.llm import decontaminate, linededup, mixing, neardup, outliers, secrets
from logsift.llm.components import connected_components
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, bucket long"


def table(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "en", s, None, "x", 1, 2) for d, t, s in rows], SCHEMA)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(20, 60))] for _ in range(8)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i * 3, " ".join(words) if i % 2 else "\n".join(words).upper(), f"s{i % 3}" if i % 7 else None))
    rows += [(500, None, "s1"), (501, "", "s1"), (502, " \n\t", ""), (503, "one two", "s0"), (504, "ONE  two", "s0"), (505, "é ü 漢 字 x y z", None)]
    rows += [(506, " ".join(vocabulary * 100), "s2"), (507, "one two", "s2")]
    return rows


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100, i) for i in range(101, 140)] + [(i, i + 1) for i in range(200, 240)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 3)], "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


@pytest.mark.parametrize("small_bucket, block", [(8, 512), (2, 3)])
def test_near_duplicates(spark, small_bucket, block):
    rows = corpus()
    settings = neardup.Settings(small_bucket=small_bucket, block=block)
    docs = table(spark, rows + rows[:3] + [(None, rows[1][1], "s1")])
    got = neardup.link(docs, settings).collect()
    want = brute.components([(d, t) for d, t, _ in rows])
    assert len(got) == len(rows) + 4
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    kept = [r.doc_id for r in neardup.keep_first(docs, settings).collect()]
    assert sorted(kept) == sorted(d for d, (_, c) in want.items() if d == c)  # repeated rows once, the copy without an id not at all


def test_repeated_rows_and_copies_without_an_id_go(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    rows = [(1, a, "s"), (1, a.upper(), "s"), (None, a, "s"), (None, a, "t"), (2, a, "s"), (None, b, "s"), (None, b + "\n", "s"), (3, None, "s"), (3, None, "s"), (None, "", "s"), (None, None, "s")]
    got = neardup.keep_first(table(spark, rows).withColumns({"key": F.lit(1), "rows": F.lit("clash")})).collect()
    assert sorted((r.doc_id or 0, (r.text or "").strip().lower()) for r in got) == [(0, ""), (0, ""), (0, b), (1, a), (3, ""), (3, "")]


def test_a_stray_in_a_large_bucket_costs_a_few_copies(spark):
    """Members of the largest component meet only the rest, so a bucket's cells grow with its size."""
    kind = "bucket long, size long, largest long, most long, key binary, component long, bands array<long>, sig binary, set binary"
    rows = [(7, 2001, 5, 2000, i.to_bytes(2), 5 if i else 9, [7], bytes(4), bytes(8)) for i in range(2001)]
    cells = neardup.cells(spark.createDataFrame(rows, kind), neardup.Settings(block=10))
    assert cells.count() == 2000 + 201 and cells.filter("component = 9").count() == 201  # the stray once per part and once by itself
    links = neardup._merging_links(spark.createDataFrame(rows, kind), neardup.Settings(block=10)).collect()
    assert links and all(bytes(2) in (r.a, r.b) for r in links)


def test_one_id_with_several_texts_ties_them(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    got = neardup.link(table(spark, [(1, a, "s"), (5, a, "s"), (5, b, "s"), (9, b, "s")])).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 5: 1, 9: 1}


def test_contained_items(spark):
    docs = corpus()
    items = [(1, docs[1][1]), (2, " ".join(docs[3][1].split()[2:14])), (3, "one two"), (4, None), (5, ""), (6, "nowhere to be found at all in here"), (7, " ".join(f"w{i}" for i in range(30)) + " x y")]
    rows = docs + docs[:2]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(table(spark, rows), bench).collect()
    want = brute.contained([(d, t) for d, t, _ in docs], items)
    assert {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got} == want and len(got) == len(want) > 5
    left = decontaminate.without_items(table(spark, rows), bench)
    bad = {p[0] for p in want}
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, _, _ in rows if d not in bad)
    assert left.columns == table(spark, []).columns


@pytest.mark.parametrize("least", [3, 6, 11])
def test_line_runs(spark, least):
    rng = random.Random(least)
    pool = ["a b c", "d", "e f", "", " ", "g h i j", "k", "a b c\r", "long " * 20]
    rows = [(i if i != 7 else None, None if i == 13 else "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14))), "s") for i in range(50)]
    rows += rows[:5]
    docs = table(spark, rows).withColumn("original", F.col("text"))
    want = brute.without_copies([(d, t) for d, t, _ in rows], least)
    got = linededup.delete_copies(docs, least).collect()
    assert len(got) == len(rows) and sum(r.n_deleted for r in got) > 20
    for r in got:
        assert r.text == (None if r.original is None else want[(r.doc_id, r.original)])


def test_mixed_sources(spark):
    rows = corpus() + [(900, "many words here", "big")] * 40 + [(901 + i, "more words " * 40, "big") for i in range(40)]
    docs = table(spark, rows)
    for ranges in (20_000, 4):
        got = mixing.mix(docs, ranges).collect()
        assert len(got) == len(rows)
        size = {}
        for _, t, s in rows:
            size[s] = size.get(s, 0) + len(brute.WORD.findall(t or ""))
        names = sorted(size, key=lambda s: (s is None, s or ""))
        weight = {s: i % 3 + 1 for i, s in enumerate(names)}
        target, free, left = {}, set(names), sum(size.values())
        while free:  # share, stop what is above, share the excess again
            share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            full = {s for s in free if share[s] > 3 * size[s]}
            if not full:
                target |= share
                break
            target |= {s: 3.0 * size[s] for s in full}
            left -= sum(3 * size[s] for s in full)
            free -= full
        taken = {}
        by_size = {r.source_size: r.target for r in got}
        assert all(0 <= r.taken <= 3 * r.size for r in got)
        for s in names:
            assert any(abs(t - target[s]) < 1e-6 for z, t in by_size.items() if z == size[s])
        for r in got:
            taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
        assert all(abs(taken[z] - by_size[z] * sum(size[s] == z for s in names)) <= len(names) for z in taken)
        assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(5), ranges).collect()))
    full = mixing.mixed_rows(docs.drop("size"))
    assert sorted((r.doc_id, r.taken) for r in full.collect()) == sorted((r.doc_id, r.taken) for r in got if r.taken)


def test_base_counts_and_outliers(spark):
    rows = corpus() + [(700, "a b c d e f " * 4, "s1"), (701, "x\nx\ny # * <b>\n\n \nx", "s1")]
    rows += [(1000 + i, " ".join(random.Random(i).choices("aa bb ccc dddd ee".split(), k=3)) + " " + " ".join(f"v{i}x{j}" for j in range(40)), "s1") for i in range(150)]
    rows += [(2000, " ".join("q" * 60 + str(i) for i in range(50)), "s1")]
    got = {r.doc_id: r for r in outliers.judge(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    for d, text, _ in rows:
        r, want = got[d], brute.base_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    assert not got[2000].kept and all(got[1000 + i].kept for i in range(150))


def test_each_statistic_rejects_alone(spark):
    def text(i, lines=8, per=9):
        rng = random.Random(i)
        return [[f"w{i}x{j}y{k}"[: rng.randint(5, 9)].ljust(5, "z") + f"{j}{k}" for k in range(per)] for j in range(lines)]

    def join(cut):
        return "\n".join(" ".join(line) for line in cut)

    rows = [(i, join(text(i, lines=6 + i % 7)), "s1") for i in range(120)]
    symbols, lines, repeats = text(500), text(501), text(502)
    for line in symbols:
        line[0], line[3] = "|", "|"
    lines = [x for line in lines for x in (line, ["more"])]
    repeats[5][1:8] = repeats[0][1:8]
    repeats[6] = [*repeats[0][1:8], "p", "q"]
    mild, once = text(503), text(504)
    mild[0][0] = "&"
    once[4] = ["Contents"]
    once[7] = ["Contents"]
    rows += [(i, join(cut), "s1") for i, cut in ((500, symbols), (501, lines), (502, repeats[:7] + text(505, 6)), (503, mild), (504, once))]
    got = {r.doc_id: r for r in outliers.judge(table(spark, rows)).collect()}
    assert not any(r.base_failed for r in got.values())
    assert got[500].n_symbols == 16 and got[501].n_dup_lines == 7 and got[501].n_repeat_words == 0 and got[502].n_repeat_words == 21 and got[502].n_dup_lines == 0
    assert sorted(d for d, r in got.items() if not r.kept) == [500, 501, 502]


def test_concentration_runs_to_the_fixed_point(spark, tmp_path):
    rng = np.random.default_rng(0)
    slow = np.round(rng.uniform(-1, 1, (6000, 5)) * [300, 400, 400, 300, 2000]).astype(int)
    fast = np.round(rng.normal(0, [100, 80, 0, 0, 800], (200, 5))).astype(int)
    names = [f"x{i}" for i in range(5)]
    made = pd.concat([pd.DataFrame(x, columns=names).assign(_group=g) for g, x in (("slow", slow), ("fast", fast))])
    spark.createDataFrame(made).write.parquet(str(tmp_path / "vectors"))
    rows = spark.read.parquet(str(tmp_path / "vectors"))
    models = outliers.estimates(rows)
    got = rows.join(models, "_group").select("_group", *names, (outliers._distance() / F.col("scale")).alias("d")).toPandas()
    for group, x in (("slow", slow), ("fast", fast)):
        want, steps = brute.mcd(x, outliers.FLOORS)
        assert (steps > 8) == (group == "slow")
        mine = got[got["_group"] == group].sort_values(names)
        order = np.lexsort(x.T[::-1])
        assert mine["d"].to_numpy() == pytest.approx(want[order], rel=1e-6, abs=1e-9)
    with pytest.raises(RuntimeError, match="rest"):
        outliers.estimates(rows, outliers.Settings(most_steps=3))


SECRETS = [
    None, "", "nothing here", "password: abcdefghijklmnop", "PassWd='short' token = 'aaaaaaaaaaaaaaaa'", "secret: secret: abcdefghijklmnop",
    "é api_key=" + "x" * 12 + " AKIA" + "A" * 14 + " AKIA123", "0123456789abcdef0 deadbeef", "ghp_" + "a" * 36, "tokenſ: abcdefghijklmnop",
    "漢字 apikey : \"0123456789abcdef\"", "AKIA" * 30, "f" * 100_000, "pass word secret_token==a=b=c=d=e=f=g",
]


def test_secrets(spark):
    rng = random.Random(5)
    texts = SECRETS + ["".join(rng.choice(["token", "=", "'", " ", "secret", "abcdef0123", "AKIA", "XYZ0", ":", "é"]) for _ in range(40)) for _ in range(60)]
    got = {r.doc_id: r for r in secrets.find_secrets(table(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, text in enumerate(texts):
        want, kinds = brute.base_spans(text), ["assign", "access", "hex"]
        shown = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in want)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == n for _, k, _ in want) for n in range(3))
        assert got[i].base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert set(shown.split(",")) - {""} <= set(got[i].spans.split(","))
    assert "github:0:40" in got[8].spans


def test_trigram_queries():
    assert secrets.trigram_query("abc") == b"abc"
    assert secrets.trigram_query("ab*c") is True
    assert secrets.trigram_query("(abc|abd)x") == ("or", (("and", (b"abc", b"bcx")), ("and", (b"abd", b"bdx"))))
    assert secrets.trigram_query("[0-9a-f]{16,}") is True


def test_empty_tables(spark):
    none = table(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    assert neardup.link(none).count() == 0 and linededup.delete_copies(none).count() == 0
    assert decontaminate.contamination(none, items).count() == 0 and decontaminate.without_items(table(spark, corpus()), items).count() == len(corpus())
    assert mixing.mix(none).count() == 0 and outliers.judge(none).count() == 0 and secrets.find_secrets(none).count() == 0


def test_shingles_keep_no_table_of_words():
    """A worker's memory does not grow with the distinct words of its texts."""
    import tracemalloc

    shingler = neardup.Shingler(5)
    shingler.hashes(["a", "b", "c", "d", "e", "f"])
    tracemalloc.start()
    try:
        for at in range(0, 200_000, 1000):
            assert len(shingler.hashes([f"w{i}" for i in range(at, at + 1000)])) == 996
        assert tracemalloc.get_traced_memory()[0] < 1 << 20
    finally:
        tracemalloc.stop()
