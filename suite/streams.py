"""Checked queries: streams of log lines, fed in three polls, one source file each."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsift.plans.triage import ReuseOptions
from logsift.sources.polling import PolledLines, lines_once, open_url, poll_urls
from logsift.staging import scratch_path
from logsift.streaming.epochs import (
    EpochFolders,
    stream_log_dir,
    stream_verdicts,
    summaries_stream,
    triage_stream,
)
from suite.fixture import LINES, lines
from suite.lines import labelled
from suite.vectors import (
    _KEYWORD_VECTOR,
    _NO_STORE,
    LINE_BATCH,
    LINE_THRESHOLD,
    keyword_vector,
    reuse_sql,
)

SOURCES = ["app-0.log", "app-1.log", "app-2.log"]
BATCH = 30


def _run(query) -> None:
    query.awaitTermination()


def _polls(spark, sf, **options) -> str:
    """Land one source, run the stream over what is new, stop, and so on.

    Every start resumes from the checkpoint, so the counters have to go on.
    """
    landing, root, checkpoint = (scratch_path(spark, part) for part in ("landing", "stream", "checkpoint"))
    for source in SOURCES:
        batch = lines(spark, sf).where(F.col("source_file") == source).orderBy("line_no")
        batch.select("raw_text").write.mode("append").text(landing)
        stream = stream_log_dir(spark, landing, glob="*.txt")
        _run(triage_stream(stream, root, checkpoint, available_now=True, **options))
    return root


def stream_batches(spark, sf):
    return stream_verdicts(spark, _polls(spark, sf, batch_size=BATCH))


def stream_counters(spark, sf):
    """Start values of the next epoch, as each epoch left them."""
    root = _polls(spark, sf, batch_size=BATCH)
    counters = spark.read.parquet(EpochFolders(root).all("counters"))
    return counters.select(F.col("epoch").cast("int"), "next_index", "next_batch")


def stream_reuse(spark, sf):
    options = ReuseOptions(LINE_THRESHOLD, "keyword-counts")
    root = _polls(spark, sf, batch_size=LINE_BATCH, reuse=options, encoder=keyword_vector)
    return stream_verdicts(spark, root)


def stream_store(spark, sf):
    """The vectors that the stream stored."""
    options = ReuseOptions(LINE_THRESHOLD, "keyword-counts")
    root = _polls(spark, sf, batch_size=LINE_BATCH, reuse=options, encoder=keyword_vector)
    store = spark.read.parquet(EpochFolders(root).all("store"))
    return store.select("id", "raw_text", "is_error", "model_name", "embedder_model_name")


def stream_json_lines(spark, sf):
    """A stream that already holds one row per batch, as JSON lines."""
    landing, path, checkpoint = (scratch_path(spark, part) for part in ("landing", "jsonl", "checkpoint"))
    marked = lines(spark, sf).select(
        F.col("line_no").alias("batch_id"), F.col("raw_text").contains("FATAL").alias("error_found")
    )
    marked.write.parquet(landing)
    stream = spark.readStream.schema(marked.schema).parquet(landing)
    _run(summaries_stream(stream, path, checkpoint, available_now=True))
    return spark.read.text(path).select(F.col("value").alias("line"))


def stream_polled_urls(spark, sf):
    """Written files polled by URL; every poll reads them whole again."""
    landing, root, checkpoint = (scratch_path(spark, part) for part in ("polled", "stream", "checkpoint"))
    lines(spark, sf).orderBy("source_file", "line_no").select("raw_text").write.text(landing)
    files = spark.read.text(landing).select(F.col("_metadata.file_path").alias("url")).distinct()
    urls = sorted(row["url"] for row in files.collect())
    for _ in range(2):
        _run(triage_stream(poll_urls(spark, *urls), root, checkpoint, available_now=True, batch_size=BATCH))
    counters = spark.read.parquet(EpochFolders(root).all("counters"))
    return counters.select(F.col("epoch").cast("int"), "next_index", "next_batch")


def _polled_twice(spark, sf, source=PolledLines, sources=SOURCES[:1], file_lines=None, **once):
    """Lines that two polls of the same files leave, by epoch; a source is one file, or files of about ``file_lines`` lines."""
    landing, root, checkpoint = (scratch_path(spark, part) for part in ("polled", "stream", "checkpoint"))
    for name in sources:
        rows = lines(spark, sf).where(F.col("source_file") == name)
        files = -(-rows.count() // file_lines) if file_lines else 1
        rows = rows.coalesce(1) if files <= 1 else rows.repartitionByRange(files, "line_no")
        rows.sortWithinPartitions("line_no").select("raw_text").write.mode("append").text(landing)
    files = spark.read.text(landing).select(F.col("_metadata.file_path").alias("url")).distinct()
    urls = sorted(row["url"] for row in files.collect())
    for _ in range(2):
        polled = poll_urls(spark, *urls, source=source)
        polled = lines_once(polled, **once) if once else polled
        _run(triage_stream(polled, root, checkpoint, available_now=True, batch_size=BATCH))
    kept = spark.read.parquet(EpochFolders(root).all("lines"))
    return kept.groupBy("epoch", "raw_text").agg(F.count("*").alias("n")).select(F.col("epoch").cast("int"), "raw_text", "n")


def stream_polled_once(spark, sf):
    """The second poll gives the same lines again, and none of them is kept."""
    return _polled_twice(spark, sf, sources=SOURCES, file_lines=250_000, keep_for="1 hour")


class Breaking:
    """A body that is lost after its first 10,000 bytes."""

    def __init__(self, url, timeout):
        self.body, self.left = open_url(url, timeout), 10_000

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.body.close()

    def read(self, size):
        if not self.left:
            raise ConnectionResetError("gone")
        data = self.body.read(min(size, self.left))
        self.left -= len(data)
        return data


class BreakingLines(PolledLines):
    opener = Breaking

    @classmethod
    def name(cls):
        return "breaking_lines"


def stream_retry(spark, sf):
    """Each poll loses its connection: lines that were whole by then are kept, and the next poll reads from the start."""
    return _polled_twice(spark, sf, BreakingLines)


def stream_store_compacted(spark, sf):
    """The stored vectors of a stream whose folders are merged in every second epoch."""
    options = ReuseOptions(LINE_THRESHOLD, "keyword-counts")
    root = _polls(spark, sf, batch_size=LINE_BATCH, reuse=options, encoder=keyword_vector, compact_every=2)
    folders = EpochFolders(root)
    store = folders.stored(spark, folders.live(spark, len(SOURCES) - 1))
    return store.select("id", "raw_text", "is_error", "model_name", "embedder_model_name")


# ---- oracles ----------------------------------------------------------------


def polled(size: int) -> str:
    """Lines with index and batch_id; batches never run across polls."""
    return f"""
SELECT *, place // {size} + before AS batch_id FROM (
 SELECT *, row_number() OVER (ORDER BY source_file, line_no) - 1 AS index,
  row_number() OVER (PARTITION BY source_file ORDER BY line_no) - 1 AS place FROM ({LINES}))
JOIN (SELECT source_file, coalesce(sum((n + {size} - 1) // {size}) OVER (ORDER BY source_file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM (SELECT source_file, count(*) AS n FROM ({LINES}) GROUP BY source_file)) USING (source_file)"""


_COUNTERS = f"""
SELECT CAST(substr(source_file, 5, 1) AS INTEGER) AS epoch, CAST(max(index) + 1 AS BIGINT) AS next_index,
 CAST(max(batch_id) + 1 AS BIGINT) AS next_batch FROM ({polled(BATCH)}) GROUP BY source_file"""
_TEXTS = f"""SELECT CAST(batch_id AS BIGINT) AS batch_id, string_agg(concat('[', index, '] ', raw_text), chr(10) ORDER BY index) AS text
FROM ({polled(LINE_BATCH)}) GROUP BY batch_id"""
_ROWS = f"""SELECT batch_id AS ord, text, {_KEYWORD_VECTOR} AS e,
 regexp_matches(upper(text), 'ERROR|FATAL|CRITICAL|EXCEPTION|FAILED|TIMEOUT|REFUSED')
  OR contains(text, ' 500 ') OR regexp_matches(text, 'HTTP/[^\\n]{{3}}" 5\\d\\d') AS own FROM ({_TEXTS})"""
_REUSE = reuse_sql(_ROWS, _NO_STORE, LINE_THRESHOLD, "keyword-counts")

CASES = {
    "stream_batches": (
        stream_batches,
        f"""SELECT CAST(batch_id AS BIGINT) AS batch_id, bool_or(is_error) AS error_found, 'keyword-rules' AS model_name,
        CAST(NULL AS VARCHAR) AS embedder_model_name FROM ({labelled(polled(BATCH))}) GROUP BY batch_id""",
    ),
    "stream_counters": (stream_counters, _COUNTERS),
    "stream_reuse": (
        stream_reuse, f"SELECT batch_id, error_found, model_name, embedder_model_name FROM ({_REUSE})",
    ),
    "stream_store": (
        stream_store,
        f"""SELECT row_number() OVER (ORDER BY batch_id) AS id, text AS raw_text, error_found AS is_error, model_name,
        embedder_model_name FROM ({_REUSE}) JOIN ({_TEXTS}) USING (batch_id) WHERE origin = 'classified'""",
    ),
    "stream_store_compacted": (
        stream_store_compacted,
        f"""SELECT row_number() OVER (ORDER BY batch_id) AS id, text AS raw_text, error_found AS is_error, model_name,
        embedder_model_name FROM ({_REUSE}) JOIN ({_TEXTS}) USING (batch_id) WHERE origin = 'classified'""",
    ),
    "stream_polled_once": (
        stream_polled_once, f"SELECT 0 AS epoch, trim(raw_text) AS raw_text, count(*) AS n FROM ({LINES}) GROUP BY ALL",
    ),
    "stream_retry": (
        stream_retry,
        f"""SELECT epoch, raw_text, count(*) AS n FROM (
         SELECT trim(raw_text) AS raw_text, sum(strlen(raw_text) + 1) OVER (ORDER BY line_no) AS bytes FROM ({LINES}) WHERE source_file = '{SOURCES[0]}'),
         unnest([0, 1]) AS t(epoch) WHERE bytes <= 10000 GROUP BY ALL""",
    ),
    "stream_json_lines": (
        stream_json_lines,
        f"""SELECT concat('{{"batch_id":', line_no, ',"error_found":', contains(raw_text, 'FATAL'),
        ',"model_name":null,"embedder_model_name":null}}') AS line FROM ({LINES})""",
    ),
    "stream_polled_urls": (
        stream_polled_urls,
        f"""SELECT CAST(poll AS INTEGER) AS epoch, (poll + 1) * n AS next_index,
        (poll + 1) * ((n + {BATCH - 1}) // {BATCH}) AS next_batch
        FROM (SELECT count(*) AS n FROM ({LINES})), (SELECT unnest([0, 1]) AS poll)""",
    ),
}
