"""The six kinds of job, end to end.

For the table modes there is a function from DataFrames to DataFrames
(``full_table``, ``marked_table``, ``dated_table``) and a driver (``run_full``,
``run_marker`` ...) that reads a source store, commits the target first and the
source after it, and keeps the audit tables in the target store.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from datetime import datetime
from functools import cached_property, partial, reduce
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rowtide.functions.coerce import readable
from rowtide.functions.keys import encode_pks, key_columns
from rowtide.operators.audit import (
    counted_flux,
    error_log,
    job_flux,
    new_errors,
    upsert_flux,
)
from rowtide.operators.compare import classify, dedupe, dedupe_rare, has_key
from rowtide.operators.replay import (
    collapse_routed,
    decide_typed,
    only_newer,
    pending_keys,
    pending_of,
    policies,
    unknown_op_rows,
    unknown_ops,
    unreadable_keys,
    unreadable_texts,
)
from rowtide.operators.sequences import sequence_plan
from rowtide.operators.slices import (
    NOTHING,
    SLICE_SECONDS,
    complete_range,
    digests_before,
    rows_before,
    rows_between,
)
from rowtide.operators.twoway import APPLIED_SCHEMA, apply_from_peer, exchange, suppress_echo
from rowtide.operators.writeback import (
    delete_by_key,
    flip_flag,
    merge,
    missing_rows,
    present_keys,
)
from rowtide.plans.spec import SyncJob, TableSpec
from rowtide.session import scratch_scope, settle, settle_parted, side_by_side, small_frame
from rowtide.sources.log import LOG_SCHEMA, ROUTE, ack_log, read_log, route_log, routed_to
from rowtide.sources.scan import project, scan, scan_flagged
from rowtide.sources.snapshots import (
    CHECKPOINT_TABLE,
    OP,
    CommitConflict,
    Partial,
    Parts,
    SnapshotStore,
    checkpoint_rows,
    load_checkpoint,
)

# Layout of the audit tables.
FLUX_TABLE = "business_db_flux"
ERROR_TABLE = "business_db_error_log"
FLUX_SCHEMA = (
    "business_name string, source_jdbc_name string, source_table_name string, "
    "target_jdbc_name string, target_table_name string, cycle int, "
    "count_i bigint, count_d bigint, count_u bigint, flag int"
)

ERROR_SCHEMA = (
    "log_time timestamp_ntz, level string, business_name string, source_jdbc_name string, "
    "source_table_name string, target_jdbc_name string, target_table_name string, pk_value string, "
    "audit_error string, operator string, flag int"
)

# What lay below the position of a date-marker job when it was saved.
DIGEST_TABLE = "marker_digests"
DIGEST_SCHEMA = (
    "job string, tablename string, version bigint, position timestamp_ntz, n bigint, x bigint"
)

# Why rows were turned away, where several places say so.
NO_MARKER = "marker is missing"
TOO_LATE = "row is older than the saved position"
BAD_KEY = "unreadable key in the change log"
BAD_OP = "unknown operation in the change log"

# Parts of the table that keeps the ids applied per key, unless the store lays it out.
GUARD_PARTS = 16

# How often a commit is built anew when other writers get in between.
COMMIT_ATTEMPTS = 5


@dataclass(frozen=True)
class TableResult:
    """Outcome of one table.

    ``changes`` holds one row per key written, with ``op``. ``added`` is set where
    the target only gained rows, so that they can be appended instead of writing
    the table anew. If the target is kept in parts, ``target`` holds the rows of
    ``parts``. What was rejected is looked for only when it is asked for. With ``count``
    the rows to be written carry :data:`~rowtide.sources.snapshots.OP`, and the pass that
    writes them counts the changes; ``changes`` would compare both sides again.
    """

    target: DataFrame
    changes: DataFrame
    kept_keys: DataFrame
    reject: Callable[[], DataFrame]
    pk: list[str]
    rest: Callable[[TableResult], DataFrame] | None = None
    added: DataFrame | None = None
    parts: list[int] | None = None
    source_parts: list[int] | None = None
    count: Observation | None = None

    @cached_property
    def rejected(self) -> DataFrame:
        """Rows (by source names) that were turned away, with ``reason``."""
        return self.reject()

    @cached_property
    def copied(self) -> DataFrame:
        """Source keys now on the target, but for those of which some row was turned away."""
        return self.kept_keys.join(
            self.rejected.select(*self.pk).distinct(), self.pk, "left_anti"
        )

    @cached_property
    def source(self) -> DataFrame | None:
        """New state of the source (of its ``source_parts``), if the job changes it."""
        return None if self.rest is None else self.rest(self)

    def source_state(self) -> DataFrame | Partial | None:
        """What to publish for the source."""
        if self.source is None or self.source_parts is None:
            return self.source
        return Partial(self.source, self.source_parts)

    def state(self) -> DataFrame | Partial:
        """What to publish for the target."""
        return self.target if self.parts is None else Partial(self.target, self.parts)


def full_table(
    source: DataFrame,
    target: DataFrame,
    spec: TableSpec,
    *,
    rows: DataFrame | None = None,
    order_by: Sequence[str] = (),
    counted: bool = False,
) -> TableResult:
    """Copy ``source`` (or the chosen ``rows`` of it) to the target by key.

    Of several rows with one key the smallest by ``order_by`` is taken. With
    ``delete_source`` the copied rows leave the source, except for keys of which
    some row was turned away: those stay until somebody has looked at them.
    """
    chosen = scan(source if rows is None else rows, spec)
    good, bad = readable(chosen, spec.fields, clob_null_to_empty=spec.clob_null_to_empty)
    kept, _ = dedupe(good, spec.pk, order_by)
    pk = spec.target_pk
    fresh = project(kept, spec.fields)
    added, refused = None, None
    if spec.insert_only:
        added = missing_rows(target, fresh, pk)
        changes = added.select(*pk, F.lit("I").alias("op"))
        new = target.unionByName(added, allowMissingColumns=True)
        if counted:
            added = added.withColumn(OP, F.lit("I"))
        there = present_keys(target, fresh, pk)
        back = there.select(*[F.col(t).alias(s) for s, t in zip(spec.pk, pk, strict=True)])
        refused = kept.join(back, spec.pk, "left_semi").select(*kept.columns)
    else:
        changes = classify(fresh.select(*pk), target, pk)
        new = merge(target, fresh, pk, op=OP if counted else None)

    def reject() -> DataFrame:
        _, twice = dedupe_rare(good, spec.pk, order_by)
        copies = F.concat(F.lit("duplicate key, copies: "), F.col("copies").cast("string"))
        reason = F.when(has_key(spec.pk), copies).otherwise(F.lit("key is missing"))
        rejected = twice.withColumn("reason", reason).drop("copies")
        if refused is not None:
            present = F.lit("key exists on an insert-only target")
            rejected = rejected.unionByName(refused.withColumn("reason", present))
        return rejected if bad is None else rejected.unionByName(bad)

    def rest(result: TableResult) -> DataFrame:
        return delete_by_key(source, result.copied, spec.pk)

    return TableResult(
        target=new,
        changes=changes,
        kept_keys=kept.select(*spec.pk),
        reject=reject,
        pk=spec.pk,
        rest=rest if spec.delete_source else None,
        added=added,
        count=Observation() if counted else None,
    )


def marked_table(
    source: DataFrame,
    target: DataFrame,
    spec: TableSpec,
    *,
    order_by: Sequence[str] = (),
    counted: bool = False,
) -> TableResult:
    """Copy the rows whose flag has its *before* value, then set it to *after*."""
    flag = spec.flag
    if flag is None:
        raise ValueError(f"table {spec.source}: no flag is declared")
    rows = scan_flagged(source, flag.name, flag.before)
    result = full_table(source, target, spec, rows=rows, order_by=order_by, counted=counted)
    if spec.delete_source:
        return result

    def rest(done: TableResult) -> DataFrame:
        return flip_flag(source, done.copied, spec.pk, flag.name, flag.after)

    return replace(result, rest=rest)


def dated_table(
    source: DataFrame,
    target: DataFrame,
    spec: TableSpec,
    *,
    start: datetime | None = None,
    seconds: int = SLICE_SECONDS,
    order_by: Sequence[str] = (),
    bounds: tuple[datetime, datetime] | None = None,
    late: DataFrame | None = None,
    counted: bool = False,
) -> TableResult:
    """Copy the rows of all complete time slices since ``start`` in one go.

    ``bounds`` are those slices' limits, see
    :func:`~rowtide.operators.slices.complete_range`. Rows without a marker belong
    to no slice and are turned away, and so are ``late`` rows, whose slices were copied
    before they came.
    """
    ts = spec.marker_column
    bounds = bounds or complete_range(source, ts, start, seconds)
    chosen = rows_between(source, ts, bounds)
    result = full_table(source, target, spec, rows=chosen, order_by=order_by, counted=counted)

    def reject() -> DataFrame:
        good, bad = readable(scan(source, spec).where(F.col(ts).isNull()), spec.fields)
        bad = good if bad is None else good.unionByName(bad.drop("reason"))
        found = result.reject().unionByName(bad.withColumn("reason", F.lit(NO_MARKER)))
        if late is None:
            return found
        good, bad = readable(scan(late, spec), spec.fields)
        bad = good if bad is None else good.unionByName(bad.drop("reason"))
        return found.unionByName(bad.withColumn("reason", F.lit(TOO_LATE)))

    return replace(result, reject=reject)


# -- drivers ---------------------------------------------------------------------


def _retry(commit: Callable[[], Any]) -> None:
    """Read, plan and commit again if another writer rewrote the same table meanwhile."""
    for attempt in range(COMMIT_ATTEMPTS):
        try:
            commit()
            return
        except CommitConflict:
            if attempt == COMMIT_ATTEMPTS - 1:
                raise


def publish_audit(
    target: SnapshotStore,
    job: SyncJob,
    flux: Sequence[DataFrame],
    errors: Sequence[DataFrame],
    cycle: int | None,
    name: str | None = None,
    *,
    once: bool = False,
) -> None:
    """Replace the flux rows of the job's tables, and add to the error log.

    With ``once`` errors that the log already holds are left out: jobs that look at whole
    tables meet the same bad rows in every cycle. Without a ``cycle`` nothing is recorded as done.
    """

    def commit() -> None:
        tables, appends, base = {}, {}, target.version
        if flux:
            old = target.read(FLUX_TABLE, schema=FLUX_SCHEMA, version=base)
            # one row per table of the job
            rows = reduce(DataFrame.unionByName, flux)
            tables[FLUX_TABLE] = upsert_flux(old, rows).coalesce(1)
        if errors:
            found = reduce(DataFrame.unionByName, errors)
            if once:
                known = target.read(ERROR_TABLE, schema=ERROR_SCHEMA, version=base)
                found = new_errors(found, known.where(F.col("business_name") == job.name))
            appends[ERROR_TABLE] = found
        target.commit(
            tables, appends=appends, job=f"{name or job.name}/audit", batch_id=cycle, base=base
        )

    _retry(commit)


def _cycle(job: SyncJob, target: SnapshotStore, cycle: int | None) -> int:
    """The given cycle number, or the one after the last that was audited."""
    if cycle is not None:
        return cycle
    return target.manifest()["batches"].get(f"{job.name}/audit", 0) + 1


def _groups(job: SyncJob) -> list[list[TableSpec]]:
    """Tables to publish together: all of a dependent job, each one of an independent job."""
    if job.dependent:
        return [[t for stage in job.stages() for t in stage]]
    return [[t] for t in job.tables]


def _commit_results(
    job: SyncJob,
    source: SnapshotStore,
    target: SnapshotStore,
    group: Sequence[TableSpec],
    results: dict[str, TableResult],
    cycle: int,
    bases: tuple[int, int],
    extra: dict[str, DataFrame] | None = None,
) -> bool:
    """Target first, source after it; ``bases`` are the versions of source and target read.

    False if this cycle of the tables was published before. The batch is recorded with the last commit only. After a crash in between,
    the whole step runs again on what the source holds by then; putting a row
    twice changes nothing.
    """
    name = f"{job.name}/{group[0].source}"
    done = [(t, results[t.source]) for t in group]
    whole = {t.target: r.state() for t, r in done if r.added is None}
    more = {t.target: r.added for t, r in done if r.added is not None}
    left = {t.source: r.source_state() for t, r in done if r.source is not None}
    if left and source.has_batch(name, cycle):
        return False
    last = None if left else cycle
    counts = {t.target: r.count for t, r in done if r.count is not None}
    new = target.commit(
        whole, appends=more | (extra or {}), job=name, batch_id=last, base=bases[1], counts=counts
    )
    if left:
        source.commit(left, job=name, batch_id=cycle, base=bases[0])
    return new


def _run_tables(
    job: SyncJob,
    source: SnapshotStore,
    target: SnapshotStore,
    cycle: int,
    plan: Callable[[DataFrame, DataFrame, TableSpec], TableResult],
    choose: Callable[[DataFrame, TableSpec], DataFrame] | None = None,
    positions: Callable[[Sequence[TableSpec]], dict[str, DataFrame]] | None = None,
    prepare: Callable[[TableSpec, DataFrame], None] | None = None,
) -> None:
    """Plan and publish all tables; ``choose`` picks the rows a partial mode copies.

    Everything is read from the versions the commits are based on. ``prepare`` sees
    the source rows of a table before they are planned. Tables that are published together
    fail together; the others, and what there is to say about them, are published all the
    same, and the first failure is raised in the end. Such a cycle is not over: the next
    one has its number and does what is missing.
    """
    results, written, failed = {}, set(), []

    def attempt(group: Sequence[TableSpec]) -> None:
        bases = source.version, target.version
        for t in group:
            rows = source.read(t.source, version=bases[0])
            if prepare:
                prepare(t, rows)
            picked = choose(rows, t) if choose else None
            old, parts = target_of(target, t, picked, version=bases[1])
            # of a source kept in parts, only those with chosen rows are rewritten
            mine, left = rows, None
            if picked is not None:
                left = source.touched(t.source, picked, version=bases[0])
            if left is not None:
                mine = source.read(t.source, version=bases[0], parts=left)
            result = plan(mine, old, t)
            results[t.source] = replace(result, parts=parts, source_parts=left)
        extra = positions(group) if positions else None
        if _commit_results(job, source, target, group, results, cycle, bases, extra):
            written.update(t.source for t in group)

    def guarded(group: Sequence[TableSpec]) -> None:
        spark = target.spark
        # what the tables of a failing group have started can be told from the others' work
        spark.addTag(f"{TAG}-{group[0].source}")
        try:
            _retry(lambda: attempt(group))
        except Exception as error:
            failed.append((group, error))
        finally:
            spark.removeTag(f"{TAG}-{group[0].source}")

    with scratch_scope(target.spark):
        side_by_side(target.spark, guarded, _groups(job))
        # what was rejected is found by the plans, which hold on to the versions they were built from
        done = [(t, results[t.source]) for t in job.tables if t.source in written]
        flux = [counted_flux(target.spark, r.count.get, job, t, cycle) for t, r in done]
        errors = [error_log(r.rejected, job, t, F.col("reason")) for t, r in done]
        for group, error in failed:
            errors += [_failure(target, job, t, error) for t in group]
        publish_audit(target, job, flux, errors, None if failed else cycle, once=True)
    if failed:
        raise failed[0][1]


# Fixed value: begin of the tags of the Spark jobs of a group of tables.
TAG = "rowtide-table"


def _failure(store: SnapshotStore, job: SyncJob, spec: TableSpec, error: Exception) -> DataFrame:
    """An error row for a table that could not be published."""
    text = " ".join(str(error).split())[:500]
    none = small_frame(store.spark, [("",)], "pks string")
    return error_log(none, job, spec, f"table failed: {type(error).__name__}: {text}")


def target_ddl(spec: TableSpec) -> str:
    """Columns of a target that does not exist yet."""
    return ", ".join(f"`{f.target}` {f.spark_type}" for f in spec.fields)


def target_of(
    store: SnapshotStore,
    spec: TableSpec,
    rows: DataFrame | None = None,
    *,
    version: int | None = None,
) -> tuple[DataFrame, list[int] | None]:
    """The target as it stands, or only the parts that the source ``rows`` go to."""
    parts = None
    if rows is not None:
        keys = project(rows.select(*spec.pk), [f for f in spec.fields if f.pk])
        parts = store.touched(spec.target, keys, version=version)
    old = store.read(spec.target, schema=target_ddl(spec), parts=parts, version=version)
    return old, parts


def run_full(
    job: SyncJob, source: SnapshotStore, target: SnapshotStore, *, cycle: int | None = None
) -> None:
    """Copy all tables whole."""
    plan = partial(full_table, counted=True)
    _run_tables(job, source, target, _cycle(job, target, cycle), plan)


def run_marker(
    job: SyncJob, source: SnapshotStore, target: SnapshotStore, *, cycle: int | None = None
) -> None:
    """Copy and mark flagged rows."""

    def choose(rows: DataFrame, spec: TableSpec) -> DataFrame:
        return scan_flagged(rows, spec.flag.name, spec.flag.before)

    plan = partial(marked_table, counted=True)
    _run_tables(job, source, target, _cycle(job, target, cycle), plan, choose)


def run_date_marker(
    job: SyncJob,
    source: SnapshotStore,
    target: SnapshotStore,
    *,
    cycle: int | None = None,
    seconds: int = SLICE_SECONDS,
) -> None:
    """Copy complete time slices; each table's new position is published with its rows."""
    number = _cycle(job, target, cycle)
    starts = {t.source: load_checkpoint(target, job.name, t.source) for t in job.tables}
    ranges: dict[str, tuple[datetime, datetime] | None] = {}
    late: dict[str, DataFrame | None] = {}
    below: dict[str, tuple] = {}

    def prepare(spec: TableSpec, rows: DataFrame) -> None:
        # the position that is saved and the rows that are copied come from one look
        name, ts, start = spec.source, spec.marker_column, starts[spec.source]
        ranges[name] = complete_range(rows, ts, start, seconds)
        reached = ranges[name][1] if ranges[name] else start
        late[name] = None
        if reached is None:
            return
        was, is_ = digests_before(rows, [*spec.pk, ts], ts, [start or reached, reached])
        below[name] = (reached, *is_)
        if start is not None and was != _saved_digest(target, job, spec, start):
            late[name] = _late_rows(rows, target, job, spec, start)

    def choose(rows: DataFrame, spec: TableSpec) -> DataFrame:
        return rows_between(rows, spec.marker_column, ranges[spec.source])

    def plan(src: DataFrame, tgt: DataFrame, spec: TableSpec) -> TableResult:
        return dated_table(
            src,
            tgt,
            spec,
            start=starts[spec.source],
            seconds=seconds,
            bounds=ranges[spec.source] or NOTHING,
            late=late[spec.source],
            counted=True,
        )

    def positions(group: Sequence[TableSpec]) -> dict[str, DataFrame]:
        values = {t.source: ranges[t.source][1] for t in group if ranges[t.source]}
        looks = [(job.name, t.source, number, *below[t.source]) for t in group if t.source in below]
        found = {}
        if values:
            found[CHECKPOINT_TABLE] = checkpoint_rows(target.spark, job.name, values, number)
        if looks:
            found[DIGEST_TABLE] = small_frame(target.spark, looks, DIGEST_SCHEMA)
        return found

    _run_tables(job, source, target, number, plan, choose, positions, prepare)


def _saved_digest(
    target: SnapshotStore, job: SyncJob, spec: TableSpec, position: datetime
) -> tuple[int, int] | None:
    """What lay below the position when it was last looked at."""
    saved = target.read(DIGEST_TABLE, schema=DIGEST_SCHEMA)
    mine = saved.where((F.col("job") == job.name) & (F.col("tablename") == spec.source))
    row = mine.agg(F.max_by(F.struct("position", "n", "x"), "version").alias("last")).first()["last"]
    return None if row is None or row["position"] != position else (row["n"], row["x"])


def _late_rows(
    rows: DataFrame, target: SnapshotStore, job: SyncJob, spec: TableSpec, position: datetime
) -> DataFrame:
    """Source rows below the position that are not on the target.

    Rows whose key the error log already names for another reason were turned away in their time.
    """
    ts, pk = spec.marker_column, spec.pk
    marker = next(f.target for f in spec.fields if f.source == ts)
    there = target.read(spec.target, schema=target_ddl(spec))
    copied = there.select(
        *[F.col(t).alias(f"_key_{i}") for i, t in enumerate(spec.target_pk)],
        F.col(marker).cast("timestamp_ntz").alias("_marker"),
    )
    old = rows_before(rows, ts, position).select(*rows.columns)
    same = [F.col(s) == F.col(f"_key_{i}") for i, s in enumerate(pk)]
    missed = old.join(
        copied, reduce(lambda a, b: a & b, same) & (F.col(ts).cast("timestamp_ntz") == F.col("_marker")), "left_anti"
    )
    known = target.read(ERROR_TABLE, schema=ERROR_SCHEMA).where(
        (F.col("business_name") == job.name)
        & (F.col("source_table_name") == spec.source)
        & (F.col("audit_error") != TOO_LATE)
    )
    told = known.select(F.col("pk_value").alias("_told")).distinct()
    return missed.join(told, encode_pks(spec.fields) == F.col("_told"), "left_anti")


def _acked(
    store: SnapshotStore, log: str, taken: DataFrame, version: int
) -> DataFrame | Partial:
    """What to publish for a log to take the rows in ``taken`` out of it."""
    # a log kept in parts (spans of ids) has only the parts of taken rows rewritten
    parts = store.touched(log, taken, version=version)
    left = ack_log(store.read(log, version=version, parts=parts), taken)
    return left if parts is None else Partial(left, parts)


def _ack(store: SnapshotStore, log: str, taken: DataFrame, job: str, cycle: int) -> None:
    """Take the rows in ``taken`` out of a log to which a capture may be adding meanwhile."""

    def commit() -> None:
        base = store.version
        state = _acked(store, log, taken, base)
        store.commit({log: state}, job=f"{job}/ack", batch_id=cycle, base=base)

    _retry(commit)


def _take(log: DataFrame, job: SyncJob, side: str, limit: int | None) -> DataFrame:
    """Pending log rows of the job's tables; the first ``limit`` of them if given."""
    specs = policies(log.sparkSession, job.tables, side=side)
    mine = read_log(log).join(
        F.broadcast(specs.select(F.col("tablename").alias("_table"))),
        F.upper("tablename") == F.col("_table"),
        "left_semi",
    )
    return mine if limit is None else mine.orderBy("id").limit(limit)


def _apply(
    store: SnapshotStore,
    decided: DataFrame,
    origin: str,
    spec: TableSpec,
    version: int,
    hashed: bool = False,
) -> tuple[DataFrame | Partial, DataFrame]:
    """What to publish for a table, and what took effect on it; reads only the parts touched."""
    parts = store.touched(spec.target, decided.select(*spec.target_pk), version=version)
    old = store.read(spec.target, schema=target_ddl(spec), parts=parts, version=version)
    new, effect = apply_from_peer(old, decided, origin, spec, skip_unchanged=hashed)
    return (new if parts is None else Partial(new, parts)), effect


def apply_log(
    job: SyncJob,
    log: DataFrame,
    source: SnapshotStore,
    target: SnapshotStore,
    *,
    cycle: int,
    batch_id: int | None = None,
    guard: bool = False,
    stream: str | None = None,
) -> None:
    """Replay log rows onto the target store and publish all tables together.

    A ``batch_id`` of the ``stream`` that was published before changes nothing.
    With ``guard`` the target also keeps the ids applied per key, in
    ``<table>__applied``, and older rows that arrive late change nothing.
    """
    name = stream or job.name
    if target.has_batch(name, batch_id):
        return
    base, source_base = target.version, source.version
    with scratch_scope(target.spark):
        # read by every table of the job, so written down once
        collapsed = collapse_routed(log, job)
        states, flux, errors = {}, [], []
        for spec, bad in zip(job.tables, unknown_ops(log, job), strict=True):
            errors.append(error_log(bad, job, spec, BAD_OP))

        def one(spec: TableSpec) -> None:
            pk = spec.target_pk
            pending = settle(pending_of(collapsed, spec))
            if guard:
                kept = f"{spec.target}__applied"
                # a store may say otherwise; whole rewrites would grow with all keys seen
                target.layout.setdefault(kept, Parts(tuple(pk), count=GUARD_PARTS))
                ids = ", ".join(f"`{f.target}` {f.spark_type}" for f in spec.fields if f.pk)
                parts = target.touched(kept, pending.select(*pk), version=base)
                seen = target.read(
                    kept, schema=f"{ids}, last_id bigint", version=base, parts=parts
                )
                pending = only_newer(pending, seen, pk)
                # one row per key: the guard does not grow with the number of batches
                new = pending.select(*pk, "_log.last_id")
                state = merge(seen, new, pk)
                states[kept] = state if parts is None else Partial(state, parts)
            # after the guard the keys depend on a second table, so they are settled again
            rows = source.read(spec.source, version=source_base)
            decided, rejected = decide_typed(rows, pending, spec, settled=not guard)
            states[spec.target], effect = _apply(target, decided, spec.source, spec, base)
            flux.append(job_flux(effect, job, spec, cycle))
            errors.append(error_log(unreadable_texts(collapsed, spec), job, spec, BAD_KEY))
            errors.append(error_log(rejected, job, spec, F.col("reason")))

        # planning reads log and sources, so tables are planned side by side; they
        # become visible together whatever their stage
        side_by_side(target.spark, one, job.tables)
        target.commit(states, job=name, batch_id=batch_id, base=base)
        publish_audit(target, job, flux, errors, cycle, name)


def run_cdc(
    job: SyncJob,
    source: SnapshotStore,
    target: SnapshotStore,
    *,
    cycle: int | None = None,
    limit: int | None = None,
) -> None:
    """Replay the pending change log, then acknowledge exactly the rows that were taken.

    Rows that were replayed but not acknowledged, after a crash, are replayed
    again, which leads to the same target. At most ``limit`` rows are taken, by
    default the ``maxrecords`` that the job declares, if it does.
    """
    number = _cycle(job, target, cycle)
    if source.has_batch(f"{job.name}/ack", number):
        return
    limit = limit or job.max_records
    with scratch_scope(target.spark):
        log = source.read(job.source_log, schema=LOG_SCHEMA, version=source.version)
        # the log is read here, once; tables and acknowledgement go by what was taken
        taken = route_log(_take(log, job, "source", limit)).drop(ROUTE)
        _retry(lambda: apply_log(job, taken, source, target, cycle=number))
        _ack(source, job.source_log, taken, job.name, number)


def run_two_way(
    job: SyncJob,
    a: SnapshotStore,
    b: SnapshotStore,
    *,
    cycle: int | None = None,
    conflict: str = "later",
) -> None:
    """Bring both sides in step.

    Each side is published once per cycle: its tables, the applied rows whose echo is to
    come, its log without the rows that were taken, and its audit, all together. Side b comes first and
    is published with an outbox, what was decided to go to side a; side a is brought up to
    date from there. So after a crash or a conflict between the sides nothing is decided
    or recorded twice. Logs captured by comparing snapshots carry ``row_hash``; then an
    echo must match it, too.
    """
    name = f"{job.name}/two_way"
    if cycle is None:
        done_a, done_b = (s.manifest()["batches"].get(name, 0) for s in (a, b))
        cycle = done_b if done_a < done_b else done_b + 1
    with scratch_scope(b.spark):
        if not b.has_batch(name, cycle):
            _retry(lambda: _publish_b(job, a, b, cycle, conflict, name))
        if not a.has_batch(name, cycle):
            _retry(lambda: _publish_a(job, a, b, cycle, conflict, name))


def _outbox(job: SyncJob, what: str) -> str:
    return f"{job.name}__outbox_{what}"


def _back_job(job: SyncJob) -> SyncJob:
    """The job as side b sees it."""
    return replace(
        job,
        source_db=job.target_db,
        target_db=job.source_db,
        tables=tuple(t.reversed() for t in job.tables),
    )


def _log_state(
    store: SnapshotStore, log: str | None, taken: DataFrame, version: int
) -> dict[str, DataFrame | Partial]:
    there = log is not None and log in store.manifest(version)["tables"]
    return {log: _acked(store, log, taken, version)} if there else {}


def _flux_state(store: SnapshotStore, flux: Sequence[DataFrame], version: int) -> DataFrame:
    old = store.read(FLUX_TABLE, schema=FLUX_SCHEMA, version=version)
    return upsert_flux(old, reduce(DataFrame.unionByName, flux)).coalesce(1)


def _first(log: DataFrame, limit: int | None) -> DataFrame | None:
    """Ids of the first rows of a routed log."""
    if not limit:
        return None
    return settle(log.orderBy("id").limit(limit).select(F.col(ROUTE).alias("_of"), F.col("id").alias("_id")))


def _whole_keys(
    rows_a: DataFrame, rows_b: DataFrame, first_a: DataFrame, first_b: DataFrame, spec: TableSpec
) -> tuple[DataFrame, DataFrame]:
    """Of both logs of a table the first rows, and all further rows of the keys that these name.

    A key whose changes were taken on one side but not yet on the other would go over
    and undo the change that is still to come, without being noticed as a conflict.
    """
    names = [f"_at_{c}" for c in spec.target_pk]

    def parts(rows: DataFrame, first: DataFrame, way: TableSpec) -> tuple[DataFrame, DataFrame]:
        keyed = key_columns(rows.withColumn("_text", F.col("pks")), way.fields, out=names)
        chosen = (F.upper("tablename") == F.col("_of")) & (F.col("id") == F.col("_id"))
        return keyed.join(first, chosen, "left_semi"), keyed.join(first, chosen, "left_anti")

    taken, later = zip(*(parts(*p) for p in ((rows_a, first_a, spec), (rows_b, first_b, spec.reversed()))), strict=True)
    keys = settle(taken[0].select(*names).union(taken[1].select(*names)).distinct())

    def chosen(now: DataFrame, rest: DataFrame, like: DataFrame) -> DataFrame:
        rows = now.unionByName(rest.join(keys, names, "left_semi").select(*now.columns))
        return settle(rows.drop(*names).withColumnRenamed("_text", "pks").select(*like.columns))

    return chosen(taken[0], later[0], rows_a), chosen(taken[1], later[1], rows_b)


def _publish_b(
    job: SyncJob, a: SnapshotStore, b: SnapshotStore, number: int, conflict: str, name: str
) -> None:
    """Decide both directions, publish side b and what is to go to side a."""
    base_a, base_b = a.version, b.version
    log_a = a.read(job.source_log, schema=LOG_SCHEMA, version=base_a)
    log_b = b.read(job.target_log, schema=LOG_SCHEMA, version=base_b)
    hashed = "row_hash" in log_a.columns and "row_hash" in log_b.columns
    # either log is read once, whatever the number of tables
    log_a, log_b = route_log(_take(log_a, job, "source", None)), route_log(_take(log_b, job, "target", None))
    first_a, first_b = (_first(log, job.max_records) for log in (log_a, log_b))
    taken_a, taken_b = [], []
    back_job = _back_job(job)
    tables, flux, errors, errors_a = {}, [], [], []

    def one(spec: TableSpec) -> None:
        back, mark = spec.reversed(), f"{spec.target}__applied"
        seen_a = a.read(f"{spec.source}__applied", schema=APPLIED_SCHEMA, version=base_a)
        seen_b = b.read(mark, schema=APPLIED_SCHEMA, version=base_b)
        mine_a, mine_b = routed_to(log_a, spec.source), routed_to(log_b, spec.target)
        if job.max_records:
            mine_a, mine_b = _whole_keys(mine_a, mine_b, first_a, first_b, spec)
        taken_a.append(mine_a.select("tablename", "id"))
        taken_b.append(mine_b.select("tablename", "id"))
        plan = exchange(
            a.read(spec.source, version=base_a),
            b.read(spec.target, schema=target_ddl(spec), version=base_b),
            mine_a,
            mine_b,
            spec,
            applied_a=seen_a,
            applied_b=seen_b,
            conflict=conflict,
            hashed=hashed,
        )
        state_b, on_b = _apply(b, plan.to_b, spec.source, spec, base_b, hashed)
        on_b = settle(on_b)
        # applied rows whose echo has now been seen have done their work
        left_b = suppress_echo(seen_b, mine_b, hashed=hashed, fields=back.fields)
        tables.update({spec.target: state_b, mark: left_b.unionByName(on_b)})
        tables[_outbox(job, spec.source)] = plan.to_a
        flux.append(job_flux(on_b, job, spec, number))
        lost = conflict_rows(plan.conflicts, spec)
        errors.append(error_log(lost, job, spec, F.col("reason"), level="WARN"))
        for found, rows, one_job, way, bad in (
            (errors, mine_a, job, spec, plan.rejected_b),
            (errors_a, mine_b, back_job, back, plan.rejected_a),
        ):
            found.append(error_log(unreadable_keys(rows, way), one_job, way, BAD_KEY))
            found.append(error_log(unknown_op_rows(rows), one_job, way, BAD_OP))
            found.append(error_log(bad, one_job, way, F.col("reason")))

    side_by_side(b.spark, one, job.tables)
    done_a, done_b = (reduce(DataFrame.union, rows) for rows in (taken_a, taken_b))
    tables |= _log_state(b, job.target_log, done_b, base_b)
    tables[_outbox(job, "taken")] = done_a
    tables[_outbox(job, "errors")] = reduce(DataFrame.unionByName, errors_a)
    tables[FLUX_TABLE] = _flux_state(b, flux, base_b)
    appends = {ERROR_TABLE: reduce(DataFrame.unionByName, errors)}
    b.commit(tables, appends=appends, job=name, batch_id=number, base=base_b)


def _publish_a(
    job: SyncJob, a: SnapshotStore, b: SnapshotStore, number: int, conflict: str, name: str
) -> None:
    """Bring side a up to date from the outbox that side b was published with.

    What applications changed on side a meanwhile is in its log and was not taken: such a
    key is left alone, unless side b always wins, and goes to side b in the next cycle.
    """
    base, box = a.version, b.version
    log = a.read(job.source_log, schema=LOG_SCHEMA, version=base)
    hashed = "row_hash" in log.columns and "row_hash" in b.read(job.target_log, schema=LOG_SCHEMA).columns
    taken = b.read(_outbox(job, "taken"), version=box)
    mine = policies(a.spark, job.tables).select(F.col("tablename").alias("_table"))
    pending = read_log(log).join(F.broadcast(mine), F.upper("tablename") == F.col("_table"), "left_semi")
    ids = taken.select(F.upper("tablename").alias("_of"), F.col("id").alias("_id"))
    same = (F.upper("tablename") == F.col("_of")) & (F.col("id") == F.col("_id"))
    then = route_log(pending.join(ids, same, "left_semi"))
    since = route_log(pending.join(ids, same, "left_anti"))
    quiet = conflict == "target" or since.isEmpty()
    back_job = _back_job(job)
    tables, flux, errors = {}, [], [b.read(_outbox(job, "errors"), version=box)]

    def one(spec: TableSpec) -> None:
        back, mark = spec.reversed(), f"{spec.source}__applied"
        decided = b.read(_outbox(job, spec.source), version=box)
        seen = a.read(mark, schema=APPLIED_SCHEMA, version=base)
        if not quiet:
            newer = routed_to(since, spec.source)
            newer = suppress_echo(newer, seen, hashed=hashed, fields=spec.fields)
            names = dict(zip(spec.target_pk, spec.pk, strict=True))
            newer = settle(pending_keys(newer, spec).select(*spec.target_pk).withColumnsRenamed(names))
            lost = decided.join(newer, spec.pk, "left_semi").withColumnsRenamed(
                dict(zip(spec.pk, back.pk, strict=True))
            )
            reason = F.concat(F.lit("changed on both sides meanwhile, operation left out: "), "_log.last_op")
            errors.append(error_log(lost, back_job, back, reason, level="WARN"))
            decided = settle(decided.join(newer, spec.pk, "left_anti"))
        state, effect = _apply(a, decided, spec.target, back, base, hashed)
        effect = settle(effect)
        left = suppress_echo(seen, routed_to(then, spec.source), hashed=hashed, fields=spec.fields)
        tables.update({spec.source: state, mark: left.unionByName(effect)})
        flux.append(job_flux(effect, back_job, back, number))

    side_by_side(a.spark, one, job.tables)
    tables |= _log_state(a, job.source_log, taken, base)
    tables[FLUX_TABLE] = _flux_state(a, flux, base)
    appends = {ERROR_TABLE: reduce(DataFrame.unionByName, errors)}
    a.commit(tables, appends=appends, job=name, batch_id=number, base=base)


def conflict_rows(conflicts: DataFrame, spec: TableSpec) -> DataFrame:
    """Keys changed on both sides as rejected rows: the losing change, and which side won."""
    lost = F.when(F.col("winner") == "target", F.col("a_op")).otherwise(F.col("b_op"))
    reason = F.concat(
        F.lit("changed on both sides, "), "winner", F.lit(" wins over operation "), lost
    )
    same_names = dict(zip(spec.target_pk, spec.pk, strict=True))
    return conflicts.select(
        *[F.col(t).alias(s) for t, s in same_names.items()], reason.alias("reason")
    )


# The sequence catalog and the catch-up plan in a store.
SEQUENCE_TABLE = "sequences"
PLAN_TABLE = "sequence_plan"


def run_sequences(
    job: SyncJob, source: DataFrame | SnapshotStore, target: DataFrame | SnapshotStore
) -> DataFrame:
    """Catch-up plan for the sequence pairs of the job, named as on the source.

    ``source`` and ``target`` are the sequence catalogs of the two sides
    (``name, last_number, increment_by, cache_size`` and perhaps ``currval``), or
    stores that hold them as ``sequences``; then the plan is published in the target
    store as ``sequence_plan``. A pair with a side missing is in the plan, too.
    """
    if isinstance(source, SnapshotStore):
        plan = run_sequences(job, source.read(SEQUENCE_TABLE), target.read(SEQUENCE_TABLE))
        target.commit({PLAN_TABLE: plan})
        return target.read(PLAN_TABLE)
    spark = source.sparkSession
    pairs = small_frame(
        spark,
        [(s.source.upper(), s.target.upper()) for s in job.sequences],
        "_source string, _target string",
    )
    pairs = F.broadcast(pairs)
    wanted = source.join(pairs, F.upper("name") == F.col("_source")).select(*source.columns)
    peer = (
        target.join(pairs, F.upper("name") == F.col("_target"))
        .withColumn("name", F.col("_source"))
        .select(*target.columns)
    )
    known = pairs.select(F.col("_source").alias("name"))
    return sequence_plan(wanted, peer, known)


# Mode names of the job file.
MODES: dict[str, Callable[..., Any]] = {
    "db_qb": run_full,
    "db_bj": run_marker,
    "db_sjbj": run_date_marker,
    "db_cf": run_cdc,
    "db_sx": run_two_way,
    "db_xl": run_sequences,
}


def run(job: SyncJob, source: Any, target: Any, **options: Any) -> Any:
    """Run a job in the mode its ``apptype`` names; one that is not active does nothing."""
    if not job.active:
        return None
    if job.apptype not in MODES:
        raise ValueError(f"job {job.name}: unknown mode {job.apptype}")
    return MODES[job.apptype](job, source, target, **options)
