"""Seconds and points of updates as a table: of each micro-batch of a stream, and of writes in batches."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..sources.schema import METRIC


class Timings(StreamingQueryListener):
    """Rows (model, op, scan_id, num_points, seconds) of all streams of a session that have a name, one a micro-batch with input.

    Add with ``spark.streams.addListener``; ``save`` appends what has come since to a table.
    A row a batch is all the driver holds between two saves.
    """

    def __init__(self, op: str = "update"):
        self.op, self.rows = op, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            self.rows.append((p.name or str(p.id), self.op, p.batchId, p.numInputRows, p.durationMs.get("triggerExecution", p.batchDuration) / 1000))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def save(self, spark: SparkSession, path: str) -> None:
        taken, self.rows = self.rows, []
        spark.createDataFrame(taken, METRIC).coalesce(1).write.mode("append").parquet(path)


def timed_write(df: DataFrame, model: str, op: str, scan_id: int, path: str, metrics: str) -> None:
    """Write a table and append its row count and seconds to the metrics table; the rows are counted while they are written."""
    seen, began = Observation(), time.time()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    row = (model, op, scan_id, seen.get["n"], time.time() - began)
    df.sparkSession.createDataFrame([row], METRIC).coalesce(1).write.mode("append").parquet(metrics)
