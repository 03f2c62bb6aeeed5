"""Rows and time of the stages of a run, counted while the rows pass: no extra job, no column of their own in the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

TIMES = "stage string, epoch long, n_rows long, total_ms double, slowest_ms double"
_MARK = "time of "


class StageTimings(StreamingQueryListener):
    """Collects what :meth:`watch` counts.

    A watched frame that is written gives one row when that is done; of several actions on it the first counts. In a stream, every
    micro-batch gives a row with its number once the listener is registered: ``spark.streams.addListener(timings)``.
    """

    def __init__(self) -> None:
        super().__init__()
        self._written: list[tuple[str, Observation]] = []
        self._epochs: list[tuple] = []

    def watch(self, df: DataFrame, stage: str, elapsed: str) -> DataFrame:
        """``df``, whose column ``elapsed`` holds milliseconds, counted under the name ``stage``."""
        counted = (
            F.count(F.lit(1)).alias("n_rows"),
            F.coalesce(F.sum(elapsed), F.lit(0.0)).alias("total_ms"),
            F.coalesce(F.max(elapsed), F.lit(0.0)).alias("slowest_ms"),
        )
        if df.isStreaming:
            return df.observe(_MARK + stage, *counted)
        seen = Observation()
        self._written.append((stage, seen))
        return df.observe(seen, *counted)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            if name.startswith(_MARK):
                stage = name.removeprefix(_MARK)
                self._epochs.append((stage, event.progress.batchId, row["n_rows"], row["total_ms"], row["slowest_ms"]))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per watched stage and run; waits for runs that were started, so ask after the actions."""
        rows = [(stage, None, *(seen.get[c] for c in ("n_rows", "total_ms", "slowest_ms"))) for stage, seen in self._written]
        return spark.createDataFrame(rows + self._epochs, TIMES)
