"""Jobs as Structured Streaming queries.

Every query hands its micro-batches to the batch operators and publishes the
outcome under the batch number. Spark repeats an unfinished batch with the same
number after a failure; one that was published is then skipped. So the source
needs no acknowledgement of its own: its offsets are in the stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rowtide.operators.audit import counted_flux, error_log
from rowtide.operators.changelog import collapse
from rowtide.operators.slices import SLICE_SECONDS, next_position
from rowtide.operators.twoway import APPLIED_SCHEMA, suppress_echo
from rowtide.operators.writeback import merge
from rowtide.plans.jobs import (
    ERROR_TABLE,
    GUARD_PARTS,
    NO_MARKER,
    TOO_LATE,
    apply_log,
    full_table,
    publish_audit,
    run,
    target_of,
)
from rowtide.plans.spec import SyncJob, TableSpec
from rowtide.session import scratch_scope, settle
from rowtide.sources.scan import scan
from rowtide.sources.snapshots import (
    CHECKPOINT_TABLE,
    Partial,
    Parts,
    SnapshotStore,
    checkpoint_rows,
    load_checkpoint,
)
from rowtide.streaming.echo_state import ROCKSDB


def start(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    *,
    once: bool,
    interval: int = 1,
    mode: str = "append",
) -> StreamingQuery:
    """Run ``handle`` for every micro-batch: all that is there now, or every ``interval`` seconds.

    A batch is read from its source once and written down: what a handler looks at
    several times is the same each time, and the progress Spark reports counts each row once.
    """

    def tidy(batch: DataFrame, number: int) -> None:
        with scratch_scope(batch.sparkSession):
            handle(settle(batch), number)

    writer = stream.writeStream.outputMode(mode).foreachBatch(tidy)
    writer = writer.option("checkpointLocation", checkpoint)
    if once:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{interval} seconds").start()


def poll(
    job: SyncJob, source: SnapshotStore, target: SnapshotStore, checkpoint: str, **options
) -> StreamingQuery:
    """Run a batch job every ``interval`` seconds until the query is stopped.

    For modes whose source is a table that changes in place, so that there are no
    arriving rows to stream. Only the clock is a stream.
    """
    clock = target.spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def handle(_: DataFrame, __: int) -> None:
        run(job, source, target, **options)

    return start(clock, handle, checkpoint, once=False, interval=job.interval)


def stream_name(batch: DataFrame, name: str) -> str:
    """Batch numbers count per stream; a stream begun anew must not reuse old ones."""
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"{name}@{query}"


def stream_full(
    stream: DataFrame,
    target: SnapshotStore,
    job: SyncJob,
    spec: TableSpec,
    checkpoint: str,
    *,
    once: bool | None = None,
) -> StreamingQuery:
    """Upsert arriving source rows; stops at the end of the input for a run-once table."""

    def handle(batch: DataFrame, number: int) -> None:
        name = stream_name(batch, f"{job.name}/{spec.source}")
        base = target.version
        old, parts = target_of(target, spec, batch, version=base)
        result = replace(full_table(batch, old, spec, counted=True), parts=parts)
        errors = error_log(result.rejected, job, spec, F.col("reason"))
        if result.added is None:
            tables, appends = {spec.target: result.state()}, {ERROR_TABLE: errors}
        else:
            tables, appends = {}, {spec.target: result.added, ERROR_TABLE: errors}
        counts = {spec.target: result.count}
        if target.commit(tables, appends=appends, job=name, batch_id=number, base=base, counts=counts):
            flux = counted_flux(target.spark, result.count.get, job, spec, number)
            publish_audit(target, job, [flux], [], number, name)

    once = spec.only_once if once is None else once
    return start(stream, handle, checkpoint, once=once, interval=job.interval)


def stream_cdc(
    log: DataFrame,
    source: SnapshotStore,
    target: SnapshotStore,
    job: SyncJob,
    checkpoint: str,
    *,
    once: bool = False,
    guard: bool = True,
) -> StreamingQuery:
    """Replay a change log as it arrives."""

    def handle(batch: DataFrame, number: int) -> None:
        apply_log(
            job,
            batch,
            source,
            target,
            cycle=number,
            batch_id=number,
            guard=guard,
            stream=stream_name(batch, job.name),
        )

    return start(log, handle, checkpoint, once=once, interval=job.interval)


def stream_collapse(
    log: DataFrame,
    store: SnapshotStore,
    table: str,
    name: str,
    checkpoint: str,
    *,
    by: Sequence[str] = ("tablename", "pks"),
    once: bool = False,
    interval: int = 1,
) -> StreamingQuery:
    """Keep the last op per key of a log that grows, see :func:`~rowtide.operators.changelog.collapse`.

    The aggregate lives in the state store: a batch changes the state of the keys it brings, and
    only these are merged into the ``table``, which is laid out in parts by key. However the
    log is cut into batches, and in whatever order they come, the table is what one
    collapse of the whole log gives: an old row that comes late changes nothing.
    """
    spark, by = log.sparkSession, list(by)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    store.layout.setdefault(table, Parts(tuple(by), count=GUARD_PARTS))
    changed = collapse(log, by)
    schema = changed._jdf.schema().toDDL()

    def handle(batch: DataFrame, number: int) -> None:
        base = store.version
        parts = store.touched(table, batch.select(*by), version=base)
        old = store.read(table, schema=schema, parts=parts, version=base)
        state = merge(old, batch, by)
        tables = {table: state if parts is None else Partial(state, parts)}
        store.commit(tables, job=stream_name(batch, name), batch_id=number, base=base)

    return start(changed, handle, checkpoint, once=once, interval=interval, mode="update")


def slice_counts(
    stream: DataFrame, ts: str, *, seconds: int = SLICE_SECONDS, lateness: str = "0 seconds"
) -> DataFrame:
    """Rows per complete time slice; append mode holds back the slice still being filled.

    Event time must be a TIMESTAMP for a watermark, so the zoneless marker is
    read as UTC, the session time zone this package expects.
    """
    return (
        stream.withColumn("_event_time", F.col(ts).cast("timestamp"))
        .withWatermark("_event_time", lateness)
        .groupBy(F.window("_event_time", f"{seconds} seconds"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .select(
            F.col("window.start").cast("timestamp_ntz").alias("slice_start"),
            F.col("window.end").cast("timestamp_ntz").alias("slice_end"),
            "n_rows",
        )
    )


def stream_date_marker(
    stream: DataFrame,
    target: SnapshotStore,
    job: SyncJob,
    spec: TableSpec,
    checkpoint: str,
    *,
    once: bool = False,
    seconds: int = SLICE_SECONDS,
) -> StreamingQuery:
    """Upsert complete time slices as rows arrive.

    Rows of the slice still being filled wait in ``<source>__waiting``. A row
    stamped before the saved position is too late, one without a stamp belongs to
    no slice; both go to the error log instead of vanishing.
    """
    ts = spec.marker_column
    waiting_table = f"{spec.source}__waiting"

    def handle(batch: DataFrame, number: int) -> None:
        name = stream_name(batch, f"{job.name}/{spec.source}")
        if target.has_batch(name, number):
            return
        spark, base = batch.sparkSession, target.version
        fresh = scan(batch, spec)
        position = load_checkpoint(target, job.name, spec.source, version=base)
        undated = fresh.where(F.col(ts).isNull())
        fresh = fresh.where(F.col(ts).isNotNull())
        late = fresh.limit(0)
        if position is not None:
            late = fresh.where(F.col(ts) < F.lit(position))
            fresh = fresh.where(F.col(ts) >= F.lit(position))
        waiting = target.read(waiting_table, schema=fresh._jdf.schema().toDDL(), version=base)
        known = waiting.unionByName(fresh)
        reached = next_position(known, ts, position, seconds).first()[0]
        errors = error_log(late, job, spec, TOO_LATE)
        appends = {ERROR_TABLE: errors.unionByName(error_log(undated, job, spec, NO_MARKER))}
        if reached is None:
            tables = {waiting_table: known}
            target.commit(tables, appends=appends, job=name, batch_id=number, base=base)
            return
        ready = known.where(F.col(ts) < F.lit(reached))
        old, parts = target_of(target, spec, ready, version=base)
        result = replace(full_table(ready, old, spec, counted=True), parts=parts)
        rejected = error_log(result.rejected, job, spec, F.col("reason"))
        appends[ERROR_TABLE] = appends[ERROR_TABLE].unionByName(rejected)
        appends[CHECKPOINT_TABLE] = checkpoint_rows(
            spark, job.name, {spec.source: reached}, number
        )
        tables = {waiting_table: known.where(F.col(ts) >= F.lit(reached))}
        if result.added is None:
            tables[spec.target] = result.state()
        else:
            appends[spec.target] = result.added
        counts = {spec.target: result.count}
        if target.commit(tables, appends=appends, job=name, batch_id=number, base=base, counts=counts):
            flux = counted_flux(spark, result.count.get, job, spec, number)
            publish_audit(target, job, [flux], [], number, name)

    return start(stream, handle, checkpoint, once=once, interval=job.interval)


# Tables of the echo filter.
FORWARDED = "forwarded"
PENDING_ECHO = "pending_echo"


def stream_echo(
    changes: DataFrame,
    store: SnapshotStore,
    name: str,
    checkpoint: str,
    *,
    once: bool = False,
    interval: int = 1,
    hashed: bool = False,
) -> StreamingQuery:
    """Forward captured changes that are no echo, as they arrive.

    ``changes`` mixes both kinds of rows in the columns of the applied-changes
    table, told apart by ``side``: ``applied`` (written here for the peer) and
    ``captured``. An applied row must arrive no later than its echo's batch. What
    is forwarded is added to the table ``forwarded``; applied rows whose echo is
    still to come are the state between batches, kept in ``pending_echo`` and
    published with the output. A keyed stateful operator would send all changes
    of a hot key through one task; this way they are split like any batch.
    """

    def handle(batch: DataFrame, number: int) -> None:
        base = store.version
        pending = store.read(PENDING_ECHO, schema=APPLIED_SCHEMA, version=base)
        columns = pending.columns
        captured = batch.where(F.col("side") == "captured").select(*columns)
        applied = pending.unionByName(batch.where(F.col("side") == "applied").select(*columns))
        store.commit(
            {PENDING_ECHO: suppress_echo(applied, captured, hashed=hashed)},
            appends={FORWARDED: suppress_echo(captured, applied, hashed=hashed)},
            job=stream_name(batch, name),
            batch_id=number,
            base=base,
        )

    return start(changes, handle, checkpoint, once=once, interval=interval)
