"""A table of a store that grows, as a stream of its new rows.

The offset of the stream is the published version: the files that name the versions are the
stream's source, so Spark's own checkpoint knows which were seen. A batch of versions stands for
the folders that they added to the table, which are read like any Parquet files. What is
written but not published is never seen, and nothing but a list of folders is planned here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rowtide.plans.jobs import apply_log
from rowtide.plans.spec import SyncJob
from rowtide.session import empty_frame, scratch_scope
from rowtide.sources.snapshots import SnapshotStore, appended_rows
from rowtide.streaming.streams import stream_name


def stream_appends(
    store: SnapshotStore,
    table: str,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    *,
    schema: str | None = None,
    max_versions: int | None = None,
    once: bool = False,
    interval: int = 1,
) -> StreamingQuery:
    """Call ``handle`` with the rows that were appended to ``table``, each once, and the batch number.

    The first batch brings the table as it stands. ``max_versions`` bounds a batch. With a ``schema`` a
    table that is not there yet is empty; without, the stream waits for it. A table that is
    written anew has no new rows to tell from old ones: then the query fails.
    """
    spark = store.spark
    published = spark.readStream.schema("value string").format("text").option("wholetext", True)
    if max_versions is not None:
        published = published.option("maxFilesPerTrigger", max_versions)
    versions = published.load(f"{store.path}/_published").select(
        F.regexp_extract("_metadata.file_name", r"^(\d+)$", 1).alias("version")
    )

    def take(batch: DataFrame, number: int) -> None:
        # one small row per version
        seen = sorted(int(r["version"]) for r in batch.where("version <> ''").distinct().collect())
        if not seen:
            return
        if any(n not in seen for n in store.versions if seen[0] < n < seen[-1]):
            raise RuntimeError("versions have come out of order")
        rows = appended_rows(store, table, seen[0], seen[-1])
        if rows is None:
            if schema is None:
                return
            rows = empty_frame(spark, schema)
        with scratch_scope(spark):
            handle(rows, number)

    writer = versions.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    if once:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{interval} seconds").start()


def stream_cdc_table(
    source: SnapshotStore, target: SnapshotStore, job: SyncJob, checkpoint: str, *, guard: bool = True, **options
) -> StreamingQuery:
    """Replay the change log that the source store keeps, as captures append to it."""

    def handle(rows: DataFrame, number: int) -> None:
        name = stream_name(rows, f"{job.name}/table")
        apply_log(job, rows, source, target, cycle=number, batch_id=number, guard=guard, stream=name)

    return stream_appends(source, job.source_log, handle, checkpoint, interval=job.interval, **options)
