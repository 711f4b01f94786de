"""Replaying a change log onto a target.

A log row only names a key; what is applied is the *current* source row. So the
last op of a key decides, and the log may be collapsed per key instead of being
walked through in order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtide.functions.coerce import failing_fields, typed_cells
from rowtide.functions.keys import key_columns
from rowtide.operators.changelog import OP_CODES, collapse
from rowtide.operators.compare import has_key
from rowtide.operators.writeback import complete, missing_rows
from rowtide.plans.spec import SyncJob, TableSpec
from rowtide.session import settle, settle_parted, side_by_side, small_frame
from rowtide.sources.log import read_log, same_table
from rowtide.sources.scan import fetch_by_keys, project

# What a collapsed key leads to: replace or add the row, add it only if absent,
# or delete it.
PUT, ADD, DROP = "P", "A", "D"


def policies(spark: SparkSession, tables: Sequence[TableSpec], *, side: str = "source") -> DataFrame:
    """Per-table policies as a DataFrame, one row per table of the job."""
    return small_frame(
        spark,
        [
            (getattr(t, side).upper(), t.insert_only, t.target_deletable, t.seqnumber)
            for t in tables
        ],
        "tablename string, insert_only boolean, target_deletable boolean, seqnumber int",
    )


def attach_spec(log: DataFrame, specs: DataFrame) -> DataFrame:
    """Log rows of the job's tables with their policies.

    ``specs`` has one row per table of the job, a handful, and is broadcast.
    """
    known = specs.withColumnRenamed("tablename", "_table")
    joined = log.join(F.broadcast(known), F.upper("tablename") == F.upper("_table"))
    return joined.drop("_table")


def apply_policy(log: DataFrame, specs: DataFrame) -> DataFrame:
    """Drop updates under insert-only and deletes on tables that may not lose rows.

    Runs before collapsing: an insert followed by an update must still insert.
    """
    allowed = (
        F.when(F.col("op") == "U", ~F.col("insert_only"))
        .when(F.col("op") == "D", F.col("target_deletable"))
        .otherwise(F.col("op") == "I")
    )
    return attach_spec(log, specs).where(allowed).select(*log.columns)


def _allowed(log: DataFrame, spec: TableSpec) -> DataFrame:
    ops = ["I"]
    if not spec.insert_only:
        ops.append("U")
    if spec.target_deletable:
        ops.append("D")
    return log.where(F.col("op").isin(*ops))


def _key_names(spec: TableSpec) -> list[str]:
    """Stand-ins for key columns, which may be called like a column of the log."""
    return [f"_key_{i}" for i in range(len(spec.pk))]


def pending_keys(log: DataFrame, spec: TableSpec) -> DataFrame:
    """Collapsed log of one table: typed key columns under their target names, and ``_log``.

    Collapsed first by key text, where most of the volume goes, then by the typed
    key. Keys that cannot be read are left out; see :func:`unreadable_keys`.
    ``_log`` is a struct of what :func:`~rowtide.operators.changelog.collapse` gives.
    """
    by_text = collapse(_allowed(read_log(log, table=spec.source), spec), ["pks"])
    return _typed(by_text, spec)


def _typed(by_text: DataFrame, spec: TableSpec) -> DataFrame:
    keys = _key_names(spec)
    typed = collapse(key_columns(by_text, spec.fields, out=keys).where(has_key(keys)), keys)
    facts = [c for c in typed.columns if c not in keys]
    return typed.select(
        *[F.col(k).alias(t) for k, t in zip(keys, spec.target_pk, strict=True)],
        F.struct(*facts).alias("_log"),
    )


def unknown_op_rows(log: DataFrame) -> DataFrame:
    """Log rows whose operation is none of the known letters."""
    return log.where(~F.coalesce(F.col("op").isin(*OP_CODES), F.lit(False)))


def unknown_ops(log: DataFrame, job: SyncJob) -> list[DataFrame]:
    """For each table of the job its log rows with an unknown operation; one pass over the log."""
    found = settle(unknown_op_rows(read_log(log)))
    return [found.where(same_table(t.source)) for t in job.tables]


def unreadable_texts(collapsed: DataFrame, spec: TableSpec) -> DataFrame:
    """Key texts (``pks``) of a table in :func:`collapse_mixed` that cannot be read, each once."""
    mine = collapsed.where(F.col("tablename") == F.lit(spec.source.upper())).select(
        "pks", F.col("pks").alias("_text")
    )
    keys = _key_names(spec)
    typed = key_columns(mine, spec.fields, out=keys)
    return typed.where(~has_key(keys)).select(F.col("_text").alias("pks"))


def unreadable_keys(log: DataFrame, spec: TableSpec) -> DataFrame:
    """Log rows of a table whose key text cannot be read."""
    rows = read_log(log, table=spec.source)
    keys = _key_names(spec)
    typed = key_columns(rows.withColumn("_text", F.col("pks")), spec.fields, out=keys)
    columns = [F.col("_text").alias("pks") if c == "pks" else F.col(c) for c in log.columns]
    return typed.where(~has_key(keys)).select(*columns)


def only_newer(pending: DataFrame, applied: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Pending keys not yet overtaken.

    ``applied`` holds the ids applied so far per key; the latest counts.
    """
    seen = (
        fetch_by_keys(applied, pending, pk)
        .groupBy(*pk)
        .agg(F.max("last_id").alias("_seen"))
    )
    return (
        pending.join(seen, list(pk), "left")
        .where(F.col("_seen").isNull() | (F.col("_log.last_id") > F.col("_seen")))
        .drop("_seen")
    )


def decide(
    source: DataFrame, pending: DataFrame, spec: TableSpec, *, settled: bool = False
) -> DataFrame:
    """What :func:`decide_typed` decides, without what it turns away."""
    return decide_typed(source, pending, spec, settled=settled)[0]


def current_rows(source: DataFrame, pending: DataFrame, spec: TableSpec) -> DataFrame:
    """Typed source rows (target names) of the pending keys, one for each key.

    ``_row`` is the row's other columns, the least of those that can be read;
    ``_good`` counts these, and ``_why`` names columns that cannot be read.
    """
    pk = spec.target_pk
    own = [replace(f, source=f.target) for f in spec.fields]
    fetched = fetch_by_keys(project(source, spec.fields), pending, pk)
    declared = {f.source: T.DataType.fromDDL(f.spark_type) for f in own}
    doubtful = [f for f in own if fetched.schema[f.source].dataType != declared[f.source]]
    failing = F.array_join(failing_fields(fetched, doubtful), ", ") if doubtful else F.lit("")
    cells = typed_cells(fetched, own, clob_null_to_empty=spec.clob_null_to_empty)
    good = F.col("_bad") == ""
    row = F.struct(F.lit(True).alias("_"), *[f.target for f in spec.fields if not f.pk])
    return (
        fetched.select(*cells, failing.alias("_bad"))
        .groupBy(*pk)
        .agg(
            F.min(F.when(good, row)).alias("_row"),
            F.sum(F.when(good, 1).otherwise(0)).alias("_good"),
            F.max(F.when(~good, F.col("_bad"))).alias("_why"),
        )
    )


def decide_typed(
    source: DataFrame, pending: DataFrame, spec: TableSpec, *, settled: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Pending keys with the current source row (target names) and the ``_action`` to take.

    ===============  ===========  ==========================================
    last op          source row   action
    ===============  ===========  ==========================================
    D                any          delete
    I or U           present      put (insert-only: add if absent, unless the
                                  log also deleted the key: then put)
    I or U           gone         delete if the log deleted the key, else none
    I or U           unreadable   none, turned away
    ===============  ===========  ==========================================

    Also returns what was turned away: keys (source names) and ``reason``. Of several
    source rows with one key one is taken and the others are reported.

    The pending keys are fetched with a semi join first, so that a short log is
    broadcast to the source instead of shuffling the source. Pending keys (unless
    they come from settled ones) and the outcome, of the size of the changes, are
    settled: they are used more than once and must not scan log and source again.
    """
    if not settled:
        pending = settle(pending)
    pk = spec.target_pk
    values = [f.target for f in spec.fields if not f.pk]
    joined = pending.join(current_rows(source, pending, spec), pk, "left")
    there, unread = F.col("_row").isNotNull(), F.col("_why").isNotNull()
    deleted, drop = F.col("_log.has_delete"), F.col("_log.last_op") == "D"
    put = F.when(deleted, PUT).otherwise(ADD) if spec.insert_only else F.lit(PUT)
    action = F.when(drop, DROP).when(there, put).when(deleted & ~unread, DROP)
    why = F.concat(F.lit("unreadable value: "), F.col("_why"))
    copies = F.concat(F.lit("duplicate key, copies: "), (F.col("_good") - 1).cast("string"))
    reason = F.when(~drop, F.when(unread, why).when(F.col("_good") > 1, copies))
    done = settle(
        joined.withColumns({"_action": action, "_reason": reason})
        .where(F.col("_action").isNotNull() | F.col("_reason").isNotNull())
        .select(
            *pk, *[F.col(f"_row.{c}").alias(c) for c in values], "_log", "_action", "_reason"
        )
    )
    names = [F.col(t).alias(s) for s, t in zip(spec.pk, pk, strict=True)]
    rejected = done.where(F.col("_reason").isNotNull()).select(
        *names, F.col("_reason").alias("reason")
    )
    return done.where(F.col("_action").isNotNull()).drop("_reason"), rejected


def apply_decided(target: DataFrame, decided: DataFrame, spec: TableSpec) -> DataFrame:
    """New state of the target."""
    pk = spec.target_pk
    mapped = [f.target for f in spec.fields]
    touched = decided.where(F.col("_action").isin(PUT, DROP)).select(*pk)
    puts = decided.where(F.col("_action") == PUT).select(*mapped)
    result = (
        target.join(touched, pk, "left_anti")
        .select(*target.columns)
        .unionByName(complete(puts, target, pk))
    )
    if spec.insert_only:
        adds = decided.where(F.col("_action") == ADD).select(*mapped)
        result = result.unionByName(missing_rows(target, adds, pk), allowMissingColumns=True)
    return result


def replay(
    source: DataFrame,
    target: DataFrame,
    log: DataFrame,
    spec: TableSpec,
    *,
    applied: DataFrame | None = None,
) -> DataFrame:
    """New state of the target after the log of one table.

    ``applied`` (target key columns and ``last_id``) keeps an old log row that
    arrives late from undoing a newer one.
    """
    pending = pending_keys(log, spec)
    if applied is not None:
        pending = only_newer(pending, applied, spec.target_pk)
    return apply_decided(target, decide(source, pending, spec), spec)


def collapse_mixed(log: DataFrame, job: SyncJob) -> DataFrame:
    """One pass over a mixed log: policies, then the last op per table and key text."""
    specs = policies(log.sparkSession, job.tables)
    allowed = apply_policy(read_log(log), specs)
    return collapse(allowed.withColumn("tablename", F.upper("tablename")), ["tablename", "pks"])


def collapse_routed(log: DataFrame, job: SyncJob) -> DataFrame:
    """:func:`collapse_mixed` written down by table, so that each table reads its own part only."""
    return settle_parted(collapse_mixed(log, job), "tablename")


def pending_of(collapsed: DataFrame, spec: TableSpec) -> DataFrame:
    """The part of :func:`collapse_mixed` that belongs to one table, with typed keys."""
    mine = collapsed.where(F.col("tablename") == F.lit(spec.source.upper())).drop("tablename")
    return _typed(mine, spec)


def replay_many(
    sources: Mapping[str, DataFrame],
    targets: Mapping[str, DataFrame],
    log: DataFrame,
    job: SyncJob,
) -> dict[str, DataFrame]:
    """New state of every target of a dependent job, by target name, in stage order.

    :func:`rowtide.plans.jobs.run_cdc` publishes them all at once, so no reader
    sees a child without its parent.
    """
    collapsed = collapse_routed(log, job)
    specs = [spec for stage in job.stages() for spec in stage]

    def state(spec: TableSpec) -> DataFrame:
        decided = decide(sources[spec.source], pending_of(collapsed, spec), spec)
        return apply_decided(targets[spec.target], decided, spec)

    states = side_by_side(log.sparkSession, state, specs)
    return dict(zip([spec.target for spec in specs], states, strict=True))
