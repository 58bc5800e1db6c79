"""Progress of streams as a table, and counts observed while frames are written."""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

PROGRESS = "name string, batch_id long, input_rows long, rows_per_second double, seconds double, state_rows long, late_rows long"


class ProgressLog(StreamingQueryListener):
    """The last ``keep`` micro-batches of all streams of a session; add it with attach()."""

    def __init__(self, keep: int = 10_000) -> None:
        self._rows: deque[tuple] = deque(maxlen=keep)
        self.failures: list[str] = []

    def onQueryStarted(self, event: QueryStartedEvent) -> None:  # noqa: N802
        """Nothing to note."""

    def onQueryIdle(self, event: QueryIdleEvent) -> None:  # noqa: N802
        """Nothing to note."""

    def onQueryProgress(self, event: QueryProgressEvent) -> None:  # noqa: N802
        """Note a micro-batch."""
        p = json.loads(event.progress.json)
        state = p.get("stateOperators") or []
        total = lambda k: sum(int(s.get(k) or 0) for s in state)
        self._rows.append((p.get("name"), p.get("batchId"), p.get("numInputRows"), float(p.get("processedRowsPerSecond") or 0), p.get("durationMs", {}).get("triggerExecution", 0) / 1000, total("numRowsTotal"), total("numRowsDroppedByWatermark")))

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:  # noqa: N802
        """Note a failure."""
        if event.exception:
            self.failures.append(event.exception)

    def attach(self, spark: SparkSession) -> ProgressLog:
        """Listen to the session's streams."""
        spark.streams.addListener(self)
        return self

    def table(self, spark: SparkSession) -> DataFrame:
        """What was noted, a row per micro-batch."""
        return spark.createDataFrame(list(self._rows), PROGRESS)
