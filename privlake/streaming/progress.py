"""Progress of streams: told to whoever listens, and kept as rows of a table."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

SCHEMA = "query string, run string, name string, event string, batch_id long, at string, input_rows long, rows_per_second double, took_ms long, state_rows long, late_rows long, error string"
_LOG = logging.getLogger(__name__)


class ProgressListener(StreamingQueryListener):
    """Tells every callback of every event of the session's streams, as a dictionary of SCHEMA's columns. A callback that fails keeps no other from being told."""

    def __init__(self):
        self.callbacks: list[Callable[[dict], None]] = []

    def subscribe(self, callback: Callable[[dict], None]) -> Callable[[], None]:
        """Adds a callback; gives the function that takes it away again."""
        self.callbacks = [*self.callbacks, callback]
        return lambda: setattr(self, "callbacks", [c for c in self.callbacks if c is not callback])

    def _tell(self, **row) -> None:
        for callback in self.callbacks:
            try:
                callback({name.split(" ")[0]: None for name in SCHEMA.split(", ")} | row)
            except Exception:
                _LOG.exception("a listener failed")

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self._tell(query=str(event.id), run=str(event.runId), name=event.name, event="started", at=event.timestamp)

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        state = p.stateOperators
        self._tell(
            query=str(p.id), run=str(p.runId), name=p.name, event="progress", batch_id=p.batchId, at=p.timestamp, input_rows=sum(max(s.numInputRows, 0) for s in p.sources), rows_per_second=float(p.processedRowsPerSecond), took_ms=int(p.batchDuration),
            state_rows=sum(s.numRowsTotal for s in state), late_rows=sum(s.numRowsDroppedByWatermark for s in state),
        )

    def onQueryIdle(self, event) -> None:
        self._tell(query=str(event.id), run=str(event.runId), event="idle", at=event.timestamp)

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self._tell(query=str(event.id), run=str(event.runId), event="terminated", error=event.exception)


def keep_progress(spark: SparkSession, path: str) -> Callable[[dict], None]:
    """A callback that appends each event but idle ones to a table; one small file per event, as there is one event per batch."""

    def append(row: dict) -> None:
        if row["event"] != "idle":
            spark.createDataFrame([tuple(row.values())], SCHEMA).coalesce(1).write.mode("append").parquet(path)

    return append


def batches(progress: DataFrame) -> DataFrame:
    """One row per batch of each query, across restarts: the last that was told of a batch that ran again, and no row for rounds without input under a number that a later batch has."""
    latest = Window.partitionBy("query", "batch_id").orderBy(F.desc("input_rows"), F.desc("at"))
    return progress.where("event = 'progress'").withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n", "event", "error")


def totals(progress: DataFrame) -> DataFrame:
    """Per query: runs, batches with input, rows read, and how long batches took."""
    runs = progress.groupBy("query").agg(F.count_distinct("run").alias("runs"))
    of = batches(progress).groupBy("query").agg(F.max("name").alias("name"), F.count_if(F.col("input_rows") > 0).alias("batches"), F.sum("input_rows").alias("input_rows"), F.sum("took_ms").alias("took_ms"))
    return of.join(runs, "query")
