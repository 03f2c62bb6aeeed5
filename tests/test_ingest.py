"""Log directories, dense indexes and batches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from logsift.operators.batching import assign_batches, batch_text, collect_entries, rule_verdicts
from logsift.operators.indexing import index_ordered, index_scanned
from logsift.sources.logfiles import scan_log_dir, scan_text_file


def sequential(directory, size):
    """What a loop over the files gives."""
    rows, index = [], 0
    for path in sorted(directory.glob("*.log")):
        for line in path.open(newline=None, encoding="utf-8"):
            line = line.rstrip("\n").rstrip("\r")
            if line:
                rows.append((index, path.name, line, index // size))
                index += 1
    return rows


def test_directory_scan_matches_a_sequential_reader(spark, tmp_path):
    rng = random.Random(7)
    for name in ("b.log", "a.log", "c.log", "skip.txt"):
        text = "".join(
            rng.choice(["", "   ", f"line {i}", "é" * rng.randint(1, 60)]) + rng.choice(["\n", "\r\n", "\r"])
            for i in range(3000)
        )
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "z.log").write_text("deeper\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        rows = assign_batches(index_scanned(scan_log_dir(spark, str(tmp_path))), 100).orderBy("index").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["index"], r["source_file"], r["raw_text"], r["batch_id"]) for r in rows] == sequential(tmp_path, 100)


def test_no_matching_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n")
    with pytest.raises(FileNotFoundError):
        scan_log_dir(spark, str(tmp_path))


def test_indexing_scanned_lines_does_not_shuffle_them(spark, tmp_path):
    (tmp_path / "a.log").write_text("x\ny\n")
    plan = index_scanned(scan_log_dir(spark, str(tmp_path)))._jdf.queryExecution().sparkPlan().toString()
    line_side = [row for row in plan.splitlines() if "FileScan text" in row]
    assert len(line_side) == 1 and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    for folder, lines in (("d1", "a\nb\n"), ("d2", "c\nd\ne\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.log").write_text(lines)
    rows = index_scanned(scan_log_dir(spark, str(tmp_path / "d*"))).orderBy("index").collect()
    assert [(r["index"], r["source_file"], r["raw_text"]) for r in rows] == [(i, "x.log", t) for i, t in enumerate("abcde")]


def test_other_splits_in_the_second_pass_are_noticed(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"line {i}\n" for i in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    indexed = index_scanned(scan_log_dir(spark, str(tmp_path)))
    assert spark.conf.get("spark.sql.files.minPartitionNum") is not None
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        with pytest.raises(Exception, match="changed while they were indexed"):
            indexed.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert indexed.select("index").distinct().count() == 4000


def test_label_source_drops_bad_bytes_and_blank_lines(spark, tmp_path):
    (tmp_path / "x.log").write_bytes(b"x\xff y\n \t \n\nz\n")
    rows = index_scanned(scan_text_file(spark, str(tmp_path / "x.log"))).orderBy("index").collect()
    assert [(r["index"], r["raw_text"]) for r in rows] == [(0, "x y"), (1, "z")]


@pytest.mark.parametrize("chunk", [1, 3, 50, 1 << 17])
def test_ordered_index_is_dense_for_any_chunk(spark, chunk):
    rng = random.Random(chunk)
    keys = sorted(
        [("hot", n) for n in rng.sample(range(10_000), 400)] + [(f"s{i:03}", rng.randrange(10**6)) for i in range(200)]
    )
    shuffled = rng.sample(keys, len(keys))
    df = spark.createDataFrame(shuffled, "source_file string, line_no long").repartition(5)
    rows = index_ordered(df, chunk=chunk).orderBy("index").collect()
    assert [(r["index"], r["source_file"], r["line_no"]) for r in rows] == [(i, *k) for i, k in enumerate(keys)]


def test_batches_cross_files_and_hold_every_line(spark):
    rows = [(f"f{n % 3}", n) for n in range(250)]
    df = spark.createDataFrame(rows, "source_file string, line_no long").withColumn("raw_text", F.lit("x"))
    batches = collect_entries(assign_batches(index_ordered(df), 100)).orderBy("batch_id").collect()
    assert [len(b["entries"]) for b in batches] == [100, 100, 50]
    assert [e["index"] for b in batches for e in b["entries"]] == list(range(250))


def test_batch_text_and_verdict(spark):
    rows = [(0, "app.log", "ERROR: database connection timed out"), (1, "app.log", "WARN: retries exhausted")]
    df = spark.createDataFrame(rows, "index long, source_file string, raw_text string")
    batched = assign_batches(df, 2)
    text = collect_entries(batched).select(batch_text(F.col("entries"))).first()[0]
    assert text == "[0] ERROR: database connection timed out\n[1] WARN: retries exhausted"
    assert rule_verdicts(batched).first().asDict() == {"batch_id": 0, "error_found": True, "n_lines": 2}


def test_single_line_batches_when_the_size_is_too_small(spark):
    df = spark.createDataFrame([(0,), (1,)], "index long")
    assert [r["batch_id"] for r in assign_batches(df, -4).orderBy("index").collect()] == [0, 1]
