"""Observed metrics of streams, stored as a table."""

from __future__ import annotations

import threading

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

METRICS_SCHEMA = ("query STRING, run STRING, batch_id LONG, name STRING, at STRING, input_rows LONG, frames LONG, "
                  "long_gaps LONG, seconds DOUBLE, gaps LONG, max_state_age DOUBLE")


class StoredMetrics(StreamingQueryListener):
    """Appends what a stream observed in each batch to a table; add it with ``spark.streams.addListener``.

    A batch that is replayed is stored again, by another run; ``read_metrics`` takes its
    last one. Progress comes after the batch, so wait for ``ended`` before reading a finished query.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__()
        self.spark, self.path = spark, path
        self._ended: dict[str, threading.Event] = {}

    def ended(self, run_id: str, timeout: float = 60.0) -> bool:
        """Wait until all progress of a run is stored."""
        return self._ended.setdefault(str(run_id), threading.Event()).wait(timeout)

    def onQueryStarted(self, event) -> None:
        self._ended.setdefault(str(event.runId), threading.Event())

    def onQueryProgress(self, event) -> None:
        p = event.progress
        rows = []
        for name, seen in p.observedMetrics.items():
            seen = seen.asDict()
            rows.append((str(p.id), str(p.runId), p.batchId, name, p.timestamp, p.numInputRows,
                         *[seen.get(c) for c in ("frames", "long_gaps", "seconds", "gaps", "max_state_age")]))
        if rows:
            self.spark.createDataFrame(rows, METRICS_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._ended.setdefault(str(event.runId), threading.Event()).set()


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metrics of each batch, once; none if nothing was stored."""
    try:
        stored = spark.read.schema(METRICS_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], METRICS_SCHEMA)
    return stored.groupBy("query", "name", "batch_id").agg(F.max_by(F.struct(
        "at", "input_rows", "frames", "long_gaps", "seconds", "gaps", "max_state_age"), "at").alias("m")).select(
        "query", "name", "batch_id", "m.*")


def running_totals(metrics: DataFrame) -> DataFrame:
    """Per query and name: frames, long gaps, rate over all gaps and the oldest state, up to the last batch."""
    return metrics.groupBy("query", "name").agg(
        F.max("batch_id").alias("last_batch"), F.sum("frames").alias("frames"), F.sum("long_gaps").alias("long_gaps"),
        F.try_divide(F.sum("gaps"), F.sum("seconds")).alias("fps"), F.max("max_state_age").alias("max_state_age"))
