"""Streams of lines: counters that go on across micro-batches, results once per epoch.

Each epoch owns its folders and overwrites them, and takes its start values
from the record of the epoch before. A replayed epoch therefore writes exactly
what it wrote the first time.

With ``compact_every`` the vector store of a stream is log-structured: each epoch leaves a manifest of the
folders that are live after it, small ones are merged from time to time, and what only manifests
older than the epoch before name is removed, as no replay can ask for it any more.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from logsift.functions.text import chomp, clamp_batch_size, clamp_poll_seconds, is_blank, strip
from logsift.operators.batching import assign_batches, collect_entries, summary
from logsift.operators.classify import Classifier, classify_batches, rule_results
from logsift.operators.indexing import index_scanned
from logsift.plans.triage import ReuseOptions, embed_batches, triage_with_reuse
from logsift.schemas import DEFAULT_BATCH_SIZE, DEFAULT_POLL_SECONDS, STORE, SUMMARY
from logsift.sources.logfiles import number_rows
from logsift.sources.store import VectorStore
from logsift.staging import read_written, temporary_stages

COUNTERS = "next_index long, next_batch long, next_id long"


def stream_log_dir(spark: SparkSession, landing: str, glob: str = "*.log", files_per_poll: int | None = None) -> DataFrame:
    """New files of a landing folder as a stream of lines."""
    reader = spark.readStream.option("pathGlobFilter", glob)
    if files_per_poll:
        reader = reader.option("maxFilesPerTrigger", files_per_poll)
    return reader.text(landing).select(
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        chomp(F.col("value")).alias("raw_text"),
    )


@dataclass(frozen=True)
class EpochFolders:
    """Where a stream keeps its lines, counters, verdicts and vectors."""

    root: str

    def of(self, kind: str, epoch: int) -> str:
        return f"{self.root.rstrip('/')}/{kind}/epoch={epoch}"

    def all(self, kind: str) -> str:
        return f"{self.root.rstrip('/')}/{kind}"

    def counters(self, spark: SparkSession, epoch: int) -> tuple[int, int, int]:
        """What the epochs before ``epoch`` used up."""
        if epoch == 0:
            return 0, 0, 0
        row = spark.read.schema(COUNTERS).parquet(self.of("counters", epoch - 1)).first()
        return row["next_index"], row["next_batch"], row["next_id"]

    def save_counters(self, spark: SparkSession, epoch: int, values: tuple[int, int, int]) -> None:
        spark.createDataFrame([values], COUNTERS).write.mode("overwrite").parquet(self.of("counters", epoch))

    def store_before(self, spark: SparkSession, epoch: int) -> DataFrame:
        """The stored rows of earlier epochs; folders of later ones are pruned."""
        schema = StructType([*STORE.fields, StructField("epoch", LongType())])
        rows = read_written(spark, schema, self.all("store"))
        if rows is None:
            return spark.createDataFrame([], STORE)
        return rows.where(F.col("epoch") < epoch).select(*STORE.names)


    def live(self, spark: SparkSession, epoch: int) -> list[str]:
        """Folders of stored rows that are live after ``epoch``, relative to the root; none before the first."""
        if epoch < 0:
            return []
        named = read_written(spark, StructType([StructField("folder", StringType())]), self.of("manifests", epoch))
        if named is not None:
            return sorted(r.folder for r in named.collect())
        # Written before manifests were kept: one folder per epoch.
        names = [f"store/epoch={e}" for e in range(epoch + 1)]
        return [n for n in names if _exists(spark, f"{self.root.rstrip('/')}/{n}")]

    def stored(self, spark: SparkSession, live: list[str]) -> DataFrame:
        if not live:
            return spark.createDataFrame([], STORE)
        return spark.read.schema(STORE).parquet(*[f"{self.root.rstrip('/')}/{name}" for name in live])

    def compact(self, spark: SparkSession, epoch: int, compact_every: int) -> None:
        """Write the manifest of ``epoch``, merging its folders if there are ``compact_every`` of them, then remove what is stale.

        The manifest is written after all that it names, and folders go after it. The ones
        named by the epoch before stay, because that is where a replay of this epoch starts.
        """
        before = self.live(spark, epoch - 1)
        now = [*before, f"store/epoch={epoch}"]
        if len(now) >= compact_every:
            self.stored(spark, now).coalesce(max(1, len(now) // 8)).write.mode("overwrite").parquet(self.of("merged", epoch))
            now = [f"merged/epoch={epoch}"]
        spark.createDataFrame([(n,) for n in now], "folder string").coalesce(1).write.mode("overwrite").parquet(self.of("manifests", epoch))
        stale = [n for n in self.live(spark, epoch - 2) if n not in before and n not in now]
        for name in [*stale, *(f"{kind}/epoch={epoch - 2}" for kind in ("manifests", "lines", "counters"))]:
            _remove(spark, f"{self.root.rstrip('/')}/{name}")


def _folder(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, path: str) -> bool:
    files, path = _folder(spark, path)
    return files.exists(path)


def _remove(spark: SparkSession, path: str) -> None:
    files, path = _folder(spark, path)
    files.delete(path, True)


def _batched(lines: DataFrame, size: int, first_index: int, first_batch: int) -> DataFrame:
    """Batches start anew with each epoch; the last one of an epoch may be short."""
    local = assign_batches(index_scanned(lines), size)
    return local.withColumns({"batch_id": F.col("batch_id") + first_batch, "index": F.col("index") + first_index})


def process_epoch(
    lines: DataFrame,
    epoch: int,
    folders: EpochFolders,
    batch_size: int = DEFAULT_BATCH_SIZE,
    classifier: Classifier | None = None,
    reuse: ReuseOptions | None = None,
    strip_lines: bool = True,
    encoder=None,
    compact_every: int | None = None,
) -> None:
    """Handle one micro-batch of ``(source_file, _block, raw_text)``.

    ``compact_every`` merges the folders of the store when there are so many, and drops the lines, counters and
    manifests that no replay needs.

    The lines are written down first: a polled body differs from read to read,
    and everything after works on what was read once.
    """
    spark = lines.sparkSession
    size = clamp_batch_size(batch_size)
    if "_line_no" in lines.columns:  # one poll of one source is one task, as it is when it is read
        lines = lines.repartition("source_file", "_block").sortWithinPartitions("source_file", "_block", "_line_no")
    lines = lines.select("source_file", "_block", "raw_text")
    if strip_lines:
        lines = lines.withColumn("raw_text", strip(F.col("raw_text"))).where(~is_blank(F.col("raw_text")))
    else:
        lines = lines.where(F.length("raw_text") > 0)
    number_rows(lines).write.mode("overwrite").parquet(folders.of("lines", epoch))
    kept = spark.read.parquet(folders.of("lines", epoch))
    n_lines = kept.count()
    index, batch, row_id = folders.counters(spark, epoch)

    with temporary_stages(spark):
        batched = _batched(kept, size, index, batch)
        if reuse is None and classifier is None:
            verdicts = rule_results(batched)  # no line text is shuffled
        elif reuse is None:
            verdicts = classify_batches(collect_entries(batched), classifier)
        else:
            batches = embed_batches(collect_entries(batched), encoder)
            store = folders.store_before(spark, epoch) if compact_every is None else folders.stored(spark, folders.live(spark, epoch - 1))
            result = triage_with_reuse(batches, store, classifier, reuse)
            verdicts = result.verdicts
            added = VectorStore.with_ids(result.new_rows, "batch_id", row_id)
            added.write.mode("overwrite").parquet(folders.of("store", epoch))
            row_id += spark.read.schema(STORE).parquet(folders.of("store", epoch)).count()
        summary(verdicts).write.mode("overwrite").option("ignoreNullFields", "false").json(
            folders.of("verdicts", epoch)
        )
    n_batches = -(-n_lines // size)
    folders.save_counters(spark, epoch, (index + n_lines, batch + n_batches, row_id))
    if compact_every is not None and reuse is not None:
        folders.compact(spark, epoch, compact_every)


def triage_stream(
    lines: DataFrame,
    root: str,
    checkpoint: str,
    poll_seconds: float = DEFAULT_POLL_SECONDS,
    available_now: bool = False,
    **options,
) -> StreamingQuery:
    """Run :func:`process_epoch` on every micro-batch of a line stream.

    ``options`` are those of :func:`process_epoch`. Verdicts are JSON lines
    under ``root/verdicts``.
    """
    folders = EpochFolders(root)
    # A session of its own per micro-batch; the frame brings it along.
    handle: Callable[[DataFrame, int], None] = lambda df, epoch: process_epoch(df, epoch, folders, **options)
    writer = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{clamp_poll_seconds(poll_seconds)} seconds").start()


def stream_verdicts(spark: SparkSession, root: str) -> DataFrame:
    """All verdicts written so far."""
    return spark.read.schema(SUMMARY).json(EpochFolders(root).all("verdicts")).select(*SUMMARY.names)


def summaries_stream(
    results: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """JSON lines of a stream that already holds one row per batch."""
    writer = (
        summary(results)
        .writeStream.format("json")
        .option("path", path)
        .option("ignoreNullFields", "false")
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
