"""Change log: capture by comparing snapshots, runs of equal ops, collapse per key."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowtide.functions.keys import encode_pks
from rowtide.operators.compare import all_of
from rowtide.operators.numbering import (
    bucket_of,
    fitting_bits,
    number_rows,
    parent_of,
    upper_levels,
)
from rowtide.plans.spec import TableSpec
from rowtide.session import settle

# Op letters and the small numbers they are aggregated as.
OP_CODES = {"I": 0, "U": 1, "D": 2}


def op_code(op: Column) -> Column:
    """Op letter as a number; fixed-width values keep aggregates hash based."""
    return F.when(op == "I", 0).when(op == "U", 1).when(op == "D", 2)


def op_letter(code: Column) -> Column:
    return F.when(code == 0, "I").when(code == 1, "U").when(code == 2, "D")


def row_hash(columns: Sequence[str], row: str | None = None) -> Column:
    """64-bit hash of the mapped columns of a row."""
    return F.xxhash64(*[F.col(f"{row}.{c}" if row else c) for c in columns])


def changed_rows(
    before: DataFrame,
    after: DataFrame,
    pk: Sequence[str],
    *,
    ops: Sequence[str] = ("I", "U", "D"),
) -> DataFrame:
    """Keys that differ between two snapshots, with ``op`` and the hash of the new row."""
    values = [c for c in after.columns if c not in pk]
    pack = lambda name: F.struct(
        F.lit(True).alias("_"), *[F.col(c) for c in values]
    ).alias(name)
    both = before.select(*pk, pack("_old")).join(
        after.select(*pk, pack("_new")), list(pk), "full"
    )
    same = all_of([F.lit(True)] + [F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")) for c in values])
    op = (
        F.when(F.col("_old").isNull(), "I")
        .when(F.col("_new").isNull(), "D")
        .when(~same, "U")
    )
    hashed = F.when(
        F.col("_new").isNotNull(),
        F.xxhash64(*[F.col(c) for c in pk], *[F.col(f"_new.{c}") for c in values]),
    )
    return (
        both.withColumn("op", op)
        .where(F.col("op").isin(*ops))
        .select(*pk, "op", hashed.alias("row_hash"))
    )


def capture_changes(
    before: DataFrame,
    after: DataFrame,
    spec: TableSpec,
    *,
    ops: Sequence[str] = ("I", "U", "D"),
    reverse: bool = False,
    dbname: str = "",
    first_id: int = 1,
    op_time: datetime | None = None,
    with_hash: bool = False,
) -> DataFrame:
    """Change-log rows that lead from snapshot ``before`` to snapshot ``after``.

    Ids follow the key order. With ``reverse`` the snapshots are of the target
    and the log names target columns and the target table. A key that changed
    appears as a delete of the old key and an insert of the new one.
    """
    side = "target" if reverse else "source"
    columns = [getattr(f, side) for f in spec.fields]
    pk = spec.target_pk if reverse else spec.pk
    # numbering looks at the changes twice; the join of both snapshots must run once
    changes = settle(changed_rows(before.select(*columns), after.select(*columns), pk, ops=ops))
    numbered = number_rows(changes, pk, out="_no")
    when = F.current_timestamp() if op_time is None else F.lit(op_time)
    table = spec.target if reverse else spec.source
    return numbered.select(
        (F.col("_no") + F.lit(first_id - 1)).cast("long").alias("id"),
        F.lit(dbname).alias("dbname"),
        F.lit(table.upper()).alias("tablename"),
        encode_pks(spec.fields, side=side).alias("pks"),
        "op",
        when.cast("timestamp_ntz").alias("op_time"),
        *(["row_hash"] if with_hash else []),
    )


def run_batches(
    log: DataFrame,
    by: Sequence[str] = ("op",),
    partition: Sequence[str] = ("tablename",),
    *,
    order: str = "id",
    bits: int | None = None,
) -> DataFrame:
    """Number the runs of equal ``by`` in id order, per ``partition`` (or over all rows).

    The log is cut into id buckets, so that a table holding most of the log, or
    the undivided mixed log, is worked on by many tasks. Runs are numbered inside
    each bucket; summaries of one row per bucket, put together in levels, then say how
    many runs came before and whether a run goes on across the border.
    """
    # a struct equals another with NULLs in the same places, so no row gets lost
    bits, levels = fitting_bits(log, order) if bits is None else (bits, upper_levels(bits))
    whole = F.struct(*partition) if partition else F.lit(0)
    group = ["_group"]
    tagged = log.withColumn("_group", whole).withColumn("_bucket", bucket_of(order, bits))
    here = Window.partitionBy(*group, "_bucket").orderBy(order)
    so_far = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.row_number().over(here) == 1
    same = all_of([F.lag(c).over(here).eqNullSafe(F.col(c)) for c in by])
    starts = F.when(~first & same, 0).otherwise(1)
    local = tagged.withColumn("_starts", starts).withColumn("_local", F.sum("_starts").over(so_far))
    key = F.struct(*by)

    summary = local.groupBy(*group, "_bucket").agg(
        F.min_by(key, order).alias("_first"),
        F.max_by(key, order).alias("_last"),
        F.sum("_starts").alias("_runs"),
    )
    shifts = _run_shifts(summary, levels)
    return local.join(shifts, [*group, "_bucket"]).select(
        *log.columns, (F.col("_local") + F.col("_shift")).cast("long").alias("run_no")
    )


def _run_shifts(summary: DataFrame, levels: int) -> DataFrame:
    """``_group, _bucket, _shift``: what is added to a bucket's own run numbers.

    That is how many runs came before, less one if a run goes on across the border.
    Inside each parent of neighbouring buckets it is found by sums; the parent, again a
    first and a last value and a number of runs, is shifted in the same way.
    """
    if levels:
        summary = summary.withColumn("_parent", parent_of())
    near = ["_group", *(["_parent"] if levels else [])]
    buckets = Window.partitionBy(*near).orderBy("_bucket")
    up_to_here = buckets.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = buckets.rowsBetween(Window.unboundedPreceding, -1)
    # struct against struct, also where the bucket is the first and there is none before
    goes_on = F.lag("_last").over(buckets).eqNullSafe(F.col("_first"))
    summary = summary.withColumn("_joined", F.when(goes_on, 1).otherwise(0))
    shift = F.coalesce(F.sum("_runs").over(before), F.lit(0)) - F.sum("_joined").over(up_to_here)
    if not levels:
        return summary.select("_group", "_bucket", shift.alias("_shift"))
    parents = summary.groupBy("_group", "_parent").agg(
        F.min_by("_first", "_bucket").alias("_first"),
        F.max_by("_last", "_bucket").alias("_last"),
        F.sum(F.col("_runs") - F.col("_joined")).alias("_runs"),
    )
    above = _run_shifts(parents.withColumnRenamed("_parent", "_bucket"), levels - 1)
    above = above.withColumnsRenamed({"_bucket": "_parent", "_shift": "_above"})
    return (
        summary.select("_group", "_bucket", "_parent", shift.alias("_inside"))
        .join(above, ["_group", "_parent"])
        .select("_group", "_bucket", (F.col("_inside") + F.col("_above")).alias("_shift"))
    )


def run_sizes(runs: DataFrame, by: Sequence[str], partition: Sequence[str]) -> DataFrame:
    """Rows and id range of every run."""
    return runs.groupBy(*partition, "run_no", *[c for c in by if c not in partition]).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
    )


def collapse(log: DataFrame, by: Sequence[str]) -> DataFrame:
    """Last op per key: ``last_op, last_id, has_delete`` (and ``last_time`` if known).

    Combines on the map side, so a key that fills a third of the log costs one
    row per task. A collapsed log can be collapsed again by a coarser key.
    """
    again = "last_op" in log.columns
    op, at = ("last_op", "last_id") if again else ("op", "id")
    time = "last_time" if again else "op_time"
    deletes = F.col("has_delete") if again else F.col("op") == "D"
    measures = [
        F.max_by(op_code(F.col(op)), at).alias("_code"),
        F.max(at).alias("last_id"),
        F.max(deletes).alias("has_delete"),
    ]
    timed = time in log.columns
    if timed:
        measures.append(F.max_by(time, at).alias("last_time"))
    return (
        log.groupBy(*by)
        .agg(*measures)
        .select(
            *by,
            op_letter(F.col("_code")).alias("last_op"),
            "last_id",
            "has_delete",
            *(["last_time"] if timed else []),
        )
    )
