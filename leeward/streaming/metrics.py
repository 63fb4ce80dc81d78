"""One row of figures per micro-batch, for as long as a stream runs.

A query itself remembers only its last batches. The listener writes every batch's figures to a table as they come; the file of a batch is
named by query and batch number, so a batch that is reported twice, or run again after a restart, has one row.
"""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

METRICS = ("query_id string, name string, batch_id long, input_rows long, output_rows long, state_rows long, "
           "dropped_rows long, duration_ms long, watermark string")


class BatchMetrics(StreamingQueryListener):
    """Registers itself with ``spark`` and writes to ``folder``, which every machine reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._ended: dict[str, threading.Event] = {}
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path, root = hadoop.Path, hadoop.Path(self.folder)
        self._fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(root)
        spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None:
        self._end(event.runId)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        states = p.stateOperators
        row = {"query_id": str(p.id), "name": p.name, "batch_id": p.batchId, "input_rows": p.numInputRows, "output_rows": p.sink.numOutputRows,
               "state_rows": sum(s.numRowsTotal for s in states), "dropped_rows": sum(s.numRowsDroppedByWatermark for s in states),
               "duration_ms": p.batchDuration, "watermark": dict(p.eventTime).get("watermark")}
        if p.numInputRows == 0 and not states:
            return                                           # an idle trigger is no batch
        stream = self._fs.create(self._path(f"{self.folder}/{p.id}-{p.batchId:012d}.json"), True)
        stream.write(bytearray((json.dumps(row) + "\n").encode()))
        stream.close()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(event.runId).set()

    def _end(self, run_id) -> threading.Event:
        return self._ended.setdefault(str(run_id), threading.Event())

    def finished(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        """Wait until the figures of an ended query are all written: they are reported in order, its end last."""
        if not self._end(query.runId).wait(seconds):
            raise TimeoutError("the stream's end has not been reported")

    def close(self) -> None:
        self.spark.streams.removeListener(self)

    def table(self) -> DataFrame:
        return self.spark.read.schema(METRICS).json(self.folder)
