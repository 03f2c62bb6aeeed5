"""Counters across polls, replays, the URL source and the stream's own store."""

from __future__ import annotations

import io
import json

import pytest
from pyspark.sql import functions as F

from logsift.operators.classify import rule_classifier
from logsift.plans.triage import ReuseOptions
from logsift.sources.polling import ArrowPollReader, PolledLines, PollReader, UrlPoll, decoded_lines, lines_once, poll_urls
from logsift.streaming.epochs import (
    EpochFolders,
    process_epoch,
    stream_log_dir,
    stream_verdicts,
    triage_stream,
)
from suite.streams import SOURCES, _polled_twice


def lines_frame(spark, rows):
    return spark.createDataFrame([("a.log", 0, r) for r in rows], "source_file string, _block long, raw_text string").coalesce(1)


def verdict_rows(spark, root):
    return [(r["batch_id"], r["error_found"]) for r in stream_verdicts(spark, root).orderBy("batch_id").collect()]


def test_counters_go_on_and_batches_end_with_the_poll(spark, tmp_path):
    landing, root, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    landing.mkdir()
    polls = [["ok", "ERROR 1", "ok", "  ", "ok"], ["FATAL"], ["ok", "ok", "timeout"]]
    for n, poll in enumerate(polls):
        (landing / f"{n}.log").write_text("\n".join(poll) + "\n")
        triage_stream(stream_log_dir(spark, str(landing)), root, checkpoint, available_now=True, batch_size=2).awaitTermination()
    assert verdict_rows(spark, root) == [(0, True), (1, False), (2, True), (3, False), (4, True)]
    lines = [json.loads(x) for path in sorted((tmp_path / "out" / "verdicts").rglob("*.json")) for x in path.read_text().splitlines()]
    assert all(list(line) == ["batch_id", "error_found", "model_name", "embedder_model_name"] for line in lines)
    # Nothing new: another start adds nothing.
    triage_stream(stream_log_dir(spark, str(landing)), root, checkpoint, available_now=True, batch_size=2).awaitTermination()
    assert len(verdict_rows(spark, root)) == 5


def test_several_polls_in_one_run(spark, tmp_path):
    landing, root = tmp_path / "in", str(tmp_path / "out")
    landing.mkdir()
    for n in range(3):
        (landing / f"{n}.log").write_text("ok\nok\nok\n")
    stream = stream_log_dir(spark, str(landing), files_per_poll=1)
    triage_stream(stream, root, str(tmp_path / "cp"), available_now=True, batch_size=2).awaitTermination()
    assert [b for b, _ in verdict_rows(spark, root)] == list(range(6))


def test_a_replayed_epoch_writes_the_same(spark, tmp_path):
    folders = EpochFolders(str(tmp_path / "out"))
    reuse = ReuseOptions(0.8, "hashed")
    first, second = lines_frame(spark, ["alpha ok"] * 4), lines_frame(spark, ["beta ERROR gone wrong"] * 3 + ["alpha ok"])
    run = lambda lines, epoch: process_epoch(lines, epoch, folders, batch_size=2, reuse=reuse)
    read = lambda: (
        verdict_rows(spark, folders.root),
        [tuple(r) for r in spark.read.parquet(folders.all("store")).select("id", "raw_text").orderBy("id").collect()],
        folders.counters(spark, 2),
    )
    run(first, 0)
    run(second, 1)
    before = read()
    run(second, 1)
    assert read() == before
    assert before[0] == [(0, False), (1, False), (2, True), (3, True)] and before[2][:2] == (8, 4)
    assert [i for i, _ in before[1]] == list(range(1, before[2][2] + 1))


def test_no_lines_in_an_epoch(spark, tmp_path):
    folders = EpochFolders(str(tmp_path / "out"))
    process_epoch(lines_frame(spark, ["x"]), 0, folders, batch_size=2)
    process_epoch(lines_frame(spark, ["  "]), 1, folders, batch_size=2, reuse=ReuseOptions())
    process_epoch(lines_frame(spark, ["y"]), 2, folders, batch_size=2, classifier=rule_classifier())
    assert verdict_rows(spark, folders.root) == [(0, False), (1, False)]


def test_directory_lines_keep_white_space(spark, tmp_path):
    folders = EpochFolders(str(tmp_path / "out"))
    process_epoch(lines_frame(spark, ["x", "  ", ""]), 0, folders, batch_size=1, strip_lines=False)
    assert folders.counters(spark, 1)[0] == 2


# ---- URL source -------------------------------------------------------------


def test_decoded_lines_for_any_chunking():
    text = " one \r\ntwo\n\n  \x0bthrée four\rfive"
    data = text.encode()
    want = [line.strip() for line in text.splitlines() if line.strip()]
    for size in range(1, len(data) + 1):
        assert list(decoded_lines(data[i : i + size] for i in range(0, len(data), size))) == want
    assert list(decoded_lines([b"a\xffb\n"])) == ["a�b"]


class Breaking(io.BytesIO):
    """Gives one chunk and then loses the connection."""

    def read(self, size=-1):
        data = super().read(6)
        if not data:
            raise ConnectionResetError("gone")
        return data


def test_a_failure_keeps_the_lines_before_it():
    reader = PollReader(["u"], 1.0, lambda url, timeout: Breaking(b"one\ntwo\nthr"))
    assert [row[2:] for row in reader.read(UrlPoll("u", 1))] == [("one", 0), ("two", 1)]

    def refuse(url, timeout):
        raise OSError("refused")

    assert list(PollReader(["u"], 1.0, refuse).read(UrlPoll("u", 1))) == []


def test_offsets_move_on_and_every_url_is_a_task():
    reader = PollReader(["u", "v"], 1.0, None)
    start, end = reader.initialOffset(), reader.latestOffset()
    assert end["poll"] > start["poll"]
    assert [(p.url, p.poll) for p in reader.partitions(start, end)] == [("u", end["poll"]), ("v", end["poll"])]
    assert reader.partitions(end, end) == []


def test_every_poll_reads_the_body_again(spark, tmp_path):
    (tmp_path / "b.txt").write_text(" one \n\nERROR two\nthree\n")
    (tmp_path / "a.txt").write_text("zero\n")
    urls = [f"file://{tmp_path}/b.txt", f"file://{tmp_path}/a.txt", f"file://{tmp_path}/missing.txt"]
    root, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for _ in range(2):
        triage_stream(poll_urls(spark, *urls), root, checkpoint, available_now=True, batch_size=2).awaitTermination()
    # Each poll: [zero, one], [ERROR two, three].
    assert verdict_rows(spark, root) == [(0, False), (1, True), (2, False), (3, True)]
    kept = spark.read.parquet(EpochFolders(root).all("lines"))
    assert kept.groupBy("epoch").count().orderBy("epoch").select("count").toPandas()["count"].tolist() == [4, 4]
    assert PolledLines.name() == "polled_lines" and kept.where(F.col("source_file") == urls[1]).count() == 2


def test_lines_of_an_earlier_poll_are_left_out(spark, tmp_path):
    body = tmp_path / "a.txt"
    url, root, checkpoint = f"file://{body}", str(tmp_path / "out"), str(tmp_path / "cp")
    for text in ("one\nsame\nsame\n", "one\nsame\nsame\nERROR two\nsame\n", "one\nsame\nsame\nERROR two\nsame\n"):
        body.write_text(text)
        triage_stream(lines_once(poll_urls(spark, url)), root, checkpoint, available_now=True, batch_size=2).awaitTermination()
    kept = spark.read.parquet(EpochFolders(root).all("lines"))
    assert sorted((r.epoch, r.raw_text) for r in kept.select("epoch", "raw_text").collect()) == [(0, "one"), (0, "same"), (0, "same"), (1, "ERROR two"), (1, "same")]
    assert verdict_rows(spark, root) == [(0, False), (1, False), (2, True)]


def test_lines_are_read_in_batches():
    """The stream's reader gives the rows of the plain one, also after a failure, without a tuple per line."""
    body = b"".join(b"line %d\n\n" % i for i in range(20_000))
    opener = lambda url, timeout: io.BytesIO(body)
    poll = UrlPoll("u", 7)
    batches = list(ArrowPollReader(["u"], 1.0, opener).read(poll))
    assert 1 < len(batches) < 10
    assert [tuple(r.values()) for b in batches for r in b.to_pylist()] == list(PollReader(["u"], 1.0, opener).read(poll))
    broken = ArrowPollReader(["u"], 1.0, lambda url, timeout: Breaking(b"one\ntwo\nthr")).read(poll)
    assert [r["raw_text"] for b in broken for r in b.to_pylist()] == ["one", "two"]
    assert isinstance(PolledLines({"urls": "u"}).streamReader(None), ArrowPollReader)


def test_state_of_seen_lines_holds_no_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    once = lines_once(poll_urls(spark, f"file://{tmp_path}/a.txt"))
    plan = once._jdf.queryExecution().analyzed().toString()
    kept = next(row for row in plan.splitlines() if "DeduplicateWithinWatermark" in row.replace(" ", ""))
    assert "_name" in kept and "raw_text" not in kept
    assert once.columns == ["source_file", "_block", "raw_text", "_line_no"]


def test_a_long_source_is_polled_as_several_files(spark, sf):
    rows = lambda **o: sorted(map(tuple, _polled_twice(spark, sf, sources=SOURCES, keep_for="1 hour", **o).collect()))
    assert rows(file_lines=100) == rows()


def test_a_compacted_store_replays_from_any_step(spark, tmp_path):
    """An epoch that fails after any of its writes gives the same rows when it runs again."""
    options = ReuseOptions(0.9)
    plain, merged = EpochFolders(str(tmp_path / "plain")), EpochFolders(str(tmp_path / "merged"))
    polls = [lines_frame(spark, [f"ERROR disk {w} failed", f"user {w} came in", f"{w} {w} {w}"]) for w in ("alpha", "beta", "gamma", "delta", "omega")]
    rows = lambda df: sorted(tuple(r) for r in df.select("id", "raw_text", "is_error").collect())
    for epoch, poll in enumerate(polls):
        process_epoch(poll, epoch, plain, batch_size=1, reuse=options)
        for step in ("save_counters", "compact", None):
            if step and epoch in (1, 3):
                # What a crash right before this step leaves behind.
                with pytest.MonkeyPatch.context() as patch:
                    patch.setattr(EpochFolders, step, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
                    with pytest.raises(RuntimeError):
                        process_epoch(poll, epoch, merged, batch_size=1, reuse=options, compact_every=3)
        process_epoch(poll, epoch, merged, batch_size=1, reuse=options, compact_every=3)
        if epoch == 4:
            process_epoch(poll, epoch, merged, batch_size=1, reuse=options, compact_every=3)
        assert rows(merged.stored(spark, merged.live(spark, epoch))) == rows(plain.store_before(spark, epoch + 1))
    assert verdict_rows(spark, merged.root) == verdict_rows(spark, plain.root)
    live = merged.live(spark, 4)
    assert len(live) < 3 and any(n.startswith("merged") for n in live)
    held = {str(p.relative_to(merged.root)) for kind in ("store", "merged") for p in (tmp_path / "merged" / kind).iterdir() if p.is_dir()}
    assert set(live) <= held and "store/epoch=0" not in held and len(held) <= 5
    assert sorted(p.name for p in (tmp_path / "merged" / "lines").iterdir()) == ["epoch=3", "epoch=4"]
