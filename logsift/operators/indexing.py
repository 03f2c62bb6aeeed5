"""Dense global line numbers without a global sort.

Both forms count first and number afterwards. What is added to each row is a
running total over a table with one row per input split (or per chunk of the
sequence), never over the lines, and that table is itself summed up in slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsift.staging import stage

# A split is four numbers in the broadcast table; this many stay under 128 MB.
MAX_BROADCAST_SPLITS = 4_000_000
MAX_SLICES = 256


def _offsets(counts: DataFrame, order: list[str], size: str) -> DataFrame:
    """Add ``_offset``, the total ``size`` of the rows before each row.

    The rows are range-partitioned into slices and written down, so that every
    later pass sees the same slices. A task sums up one slice; only the totals
    of the slices, a few hundred at most, are summed up in one place.
    """
    slices = min(MAX_SLICES, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sliced = counts.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id())
    sliced = stage(sliced, "counts")
    inside = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sliced.groupBy("_slice")
        .agg(F.sum(size).alias("_total"))
        .select("_slice", F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_start"))
    )
    within = sliced.withColumn("_within", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return (
        within.join(F.broadcast(starts), "_slice")  # at most MAX_SLICES rows
        .withColumn("_offset", F.col("_start") + F.col("_within"))
        .drop("_slice", "_start", "_within")
    )


def index_scanned(scanned: DataFrame) -> DataFrame:
    """``index`` for lines of a text scan, in file-name and then file order.

    The lines are not shuffled: the position inside a block comes from the scan,
    and the table of block offsets is broadcast while its counted size allows it.
    A line outside the counted blocks fails the query; none is lost or numbered twice.
    """
    keys = [c for c in ("source_file", "_path", "_block") if c in scanned.columns]
    counts = scanned.groupBy(*keys).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    split = F.xxhash64(*keys).alias("_split")
    offsets = _offsets(counts, keys, "_lines").select(split, "_first", "_lines", "_offset")
    if offsets.count() <= MAX_BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    place = F.col("_row") - F.col("_first")
    known = (place >= 0) & (place < F.col("_lines"))
    changed = F.raise_error(F.lit("the files or their splits changed while they were indexed"))
    return (
        scanned.withColumn("_split", split).join(offsets, "_split", "left")
        .withColumn("index", F.when(known, F.col("_offset") + place).otherwise(changed))
        .drop("_split", "_path", "_block", "_row", "_first", "_lines", "_offset")
    )


def index_ordered(
    lines: DataFrame,
    source: str = "source_file",
    sequence: str = "line_no",
    chunk: int = 1 << 17,
) -> DataFrame:
    """``index`` for rows whose order is (source, sequence), a whole number unique per source.

    Each source is cut into chunks of the sequence, so a source with a third of
    all rows is spread like any other. One shuffle: rows are ranked inside their
    chunk, and the offsets join reuses that partitioning. The chunks are counted
    when this is called. Null sources come first, and so do null sequences in
    their source, in no fixed order.
    """
    keyed = lines.withColumn("_chunk", F.expr(f"`{sequence}` div {chunk}L"))
    # As a struct the pair is never null, so null keys meet their offset.
    keyed = keyed.withColumn("_part", F.struct(F.col(source).alias("source"), "_chunk"))
    counts = keyed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = _offsets(counts, ["_part"], "_rows").drop("_rows")
    inside = Window.partitionBy("_part").orderBy(sequence)
    return (
        keyed.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(offsets, "_part")
        .withColumn("index", F.col("_offset") + F.col("_rank"))
        .drop("_part", "_chunk", "_rank", "_offset")
    )
