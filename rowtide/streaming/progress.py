"""How many rows every micro-batch of a stream has processed, kept as rows.

A listener notes the progress that Spark reports; the streams of this package read each batch
once, so the rows it reports are the rows that came. Nothing is counted a second time.
"""

from __future__ import annotations

import threading
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from rowtide.session import small_frame
from rowtide.sources.snapshots import SnapshotStore

# Layout of the table that keeps the progress.
PROGRESS_TABLE = "stream_progress"
PROGRESS_SCHEMA = (
    "query_id string, run_id string, name string, batch_id bigint, started timestamp_ntz, "
    "n_rows bigint, millis bigint, state_rows bigint"
)


class ProgressLog(StreamingQueryListener):
    """Progress of the queries of a session since :meth:`watch`; batches that found nothing are left out."""

    def __init__(self) -> None:
        self._changed = threading.Condition()
        self._rows: list[tuple] = []
        self._ended: set[str] = set()

    def watch(self, spark: SparkSession) -> ProgressLog:
        spark.streams.addListener(self)
        return self

    def unwatch(self, spark: SparkSession) -> None:
        spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            started = datetime.fromisoformat(p.timestamp).replace(tzinfo=None)
            millis = int(p.durationMs.get("triggerExecution", 0))
            state = sum(s.numRowsTotal for s in p.stateOperators)
            row = (str(p.id), str(p.runId), p.name, p.batchId, started, p.numInputRows, millis, state)
            with self._changed:
                self._rows.append(row)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._changed:
            self._ended.add(str(event.runId))
            self._changed.notify_all()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until all that the ended ``query`` reported is here; reports come a little later than results."""
        with self._changed:
            if not self._changed.wait_for(lambda: str(query.runId) in self._ended, seconds):
                raise TimeoutError("the query has not ended, or its session is not watched")

    def rows(self, spark: SparkSession) -> DataFrame:
        """One row per batch."""
        with self._changed:
            return small_frame(spark, list(self._rows), PROGRESS_SCHEMA)

    def publish(self, store: SnapshotStore) -> int:
        """Add what was noted since the last call to the store; the number of rows added."""
        with self._changed:
            found, self._rows = self._rows, []
        if found:
            store.commit(appends={PROGRESS_TABLE: small_frame(store.spark, found, PROGRESS_SCHEMA)})
        return len(found)
