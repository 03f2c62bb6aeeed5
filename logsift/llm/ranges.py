"""Places of rows in a global order by one range shuffle, without a global sort in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.staging import stage

# Ranges are counted on the driver; a range grows beyond its size before there are more than this.
MOST_RANGES = 1 << 16


def in_ranges(rows: DataFrame, order: list[str], rows_per_range: int, tie: str = "tie") -> DataFrame:
    """``rows``, a written table, with the number ``range`` of their range in ``order``; a written table.

    ``tie`` numbers the rows, so that rows equal in ``order`` do not have to meet in one task. It is
    derived from the place in the written table, hence the same in every attempt of a task. The range
    is written before it is used: a repeated shuffle cannot move a row.
    """
    count = rows.count()
    parts = min(MOST_RANGES, max(1, math.ceil(count / rows_per_range)))
    known = rows.withColumn(tie, F.monotonically_increasing_id())
    return stage(known.repartitionByRange(parts, *order, tie).withColumn("range", F.spark_partition_id()), "ranges")
