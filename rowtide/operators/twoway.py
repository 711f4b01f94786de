"""Two-way synchronisation: echo suppression, conflicts, applying peer changes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowtide.functions.keys import comparable_pks, encode_pks
from rowtide.operators.changelog import row_hash
from rowtide.operators.compare import all_of
from rowtide.operators.numbering import BUCKET_BITS, bucket_of, earlier_sums, upper_levels
from rowtide.operators.replay import ADD, DROP, PUT, apply_decided, decide_typed, pending_keys
from rowtide.plans.spec import FieldSpec, TableSpec
from rowtide.session import settle, side_by_side
from rowtide.sources.log import same_table
from rowtide.sources.scan import fetch_by_keys

# Columns of the applied-changes table.
APPLIED_SCHEMA = "origin string, tablename string, pks string, op string, id bigint, row_hash bigint"


def _echo_group(df: DataFrame, hashed: bool, fields: Sequence[FieldSpec] | None, side: str) -> DataFrame:
    key = comparable_pks(F.col("pks"), fields, side=side)
    parts = {"_table": F.upper("tablename"), "_pks": key, "_op": F.col("op")}
    if hashed:
        parts["_hash"] = F.coalesce("row_hash", F.lit(0).cast("long"))
    # in front of the exact columns: sorting mostly compares this number only
    return df.withColumns({"_digest": F.xxhash64(*parts.values()), **parts})


def suppress_echo(
    captured: DataFrame,
    applied: DataFrame,
    *,
    hashed: bool = False,
    bits: int = BUCKET_BITS,
    fields: Sequence[FieldSpec] | None = None,
    side: str = "source",
) -> DataFrame:
    """Captured changes that did not come from the peer.

    Every applied row cancels one captured row of the same table, key and op (and
    row hash, with ``hashed``, for logs captured by comparing snapshots), the
    earliest first. Keys are compared without the type names in their text, and by typed
    values where the ``fields`` of the table are given. Captured rows are counted per
    group and id bucket, so that only the bucket where the applied rows run out has to be
    ranked and a key that fills a third of the log is split over many tasks.
    """
    group = ["_digest", "_table", "_pks", "_op", *(["_hash"] if hashed else [])]
    mine = _echo_group(applied, hashed, fields, side)
    budget = mine.groupBy(*group).agg(F.count(F.lit(1)).alias("_budget"))
    tagged = _echo_group(captured, hashed, fields, side).withColumn("_bucket", bucket_of("id", bits))
    return _beyond_budget(tagged, budget, group, bits).select(*captured.columns)


def _beyond_budget(tagged: DataFrame, budget: DataFrame, group: list[str], bits: int) -> DataFrame:
    """Rows of ``tagged`` but for the first ``_budget`` of each group, by id."""
    counts = tagged.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    spent = (
        earlier_sums(counts, group, levels=upper_levels(bits))
        .join(budget, group)
        .where(F.col("_before") < F.col("_budget"))
    )
    # the counts of a bucket go in front of its rows, so that one sort serves both
    marked = tagged.withColumn("_is_row", F.lit(1)).unionByName(
        spent.withColumn("_is_row", F.lit(0)), allowMissingColumns=True
    )
    here = Window.partitionBy(*group, "_bucket").orderBy("_is_row", "id")
    so_far = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = F.first(F.struct("_before", "_budget", "_is_row")).over(so_far)
    ranked = marked.withColumn("_counts", counts).withColumn("_place", F.row_number().over(here))
    nth = F.col("_counts._before") + F.col("_place") - 1
    sent = (F.col("_counts._is_row") == 1) | (nth > F.col("_counts._budget"))
    return ranked.where((F.col("_is_row") == 1) & sent)


def apply_from_peer(
    target: DataFrame,
    decided: DataFrame,
    origin: str,
    spec: TableSpec,
    *,
    skip_unchanged: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Apply decided changes and record what took effect: ``(target, applied)``.

    The recorded op is the one the peer's own capture will see: putting an
    existing key is an update, deleting a missing one is nothing. Triggers see an
    update that changes nothing, snapshot comparison does not; for the latter
    pass ``skip_unchanged``.
    """
    pk = spec.target_pk
    columns = [f.target for f in spec.fields]
    values = [c for c in columns if c not in pk]
    existing = fetch_by_keys(target, decided, pk).select(
        *pk, F.struct(F.lit(True).alias("_"), *[F.col(c) for c in values]).alias("_old")
    )
    here = F.col("_old").isNotNull()
    same = all_of([F.lit(True)] + [F.col(c).eqNullSafe(F.col(f"_old.{c}")) for c in values])
    put = F.when(~here, "I").when(F.lit(skip_unchanged) & same, None).otherwise("U")
    op = (
        F.when((F.col("_action") == DROP) & here, "D")
        .when(F.col("_action") == PUT, put)
        .when((F.col("_action") == ADD) & ~here, "I")
    )
    applied = (
        decided.join(existing, pk, "left")
        .withColumn("_op", op)
        .where(F.col("_op").isNotNull())
        .select(
            F.lit(origin).alias("origin"),
            F.lit(spec.target.upper()).alias("tablename"),
            encode_pks(spec.fields, side="target").alias("pks"),
            F.col("_op").alias("op"),
            F.col("_log.last_id").alias("id"),
            F.when(F.col("_op") != "D", row_hash([*pk, *values])).alias("row_hash"),
        )
    )
    return apply_decided(target, decided, spec), applied


@dataclass(frozen=True)
class Exchange:
    """What one two-way cycle sends each way, decided but not applied.

    ``rejected_a`` and ``rejected_b`` are the keys whose row could not go to that side
    (or not all of its copies), named as where they came from, with ``reason``.
    """

    to_a: DataFrame
    to_b: DataFrame
    conflicts: DataFrame
    rejected_a: DataFrame
    rejected_b: DataFrame


@dataclass(frozen=True)
class TwoWay:
    """Outcome of one two-way cycle."""

    a: DataFrame
    b: DataFrame
    conflicts: DataFrame
    applied_a: DataFrame
    applied_b: DataFrame


def find_conflicts(
    pending_a: DataFrame, pending_b: DataFrame, pk: Sequence[str], conflict: str = "later"
) -> DataFrame:
    """Keys changed on both sides, with both changes and the ``winner``.

    ``conflict``: ``later`` (by time, then id, then the source), ``source`` or ``target``.
    """
    if conflict not in ("later", "source", "target"):
        raise ValueError(f"conflict: {conflict}")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            *pk,
            F.col("_log.last_op").alias(f"{name}_op"),
            F.col("_log.last_id").alias(f"{name}_id"),
            F.col("_log.last_time").alias(f"{name}_time"),
        )

    winner: Column = F.lit(conflict)
    if conflict == "later":
        newer_b = (F.col("b_time") > F.col("a_time")) | (
            F.col("b_time").eqNullSafe(F.col("a_time")) & (F.col("b_id") > F.col("a_id"))
        )
        winner = F.when(newer_b, "target").otherwise("source")
    return side(pending_a, "a").join(side(pending_b, "b"), list(pk)).withColumn("winner", winner)


def exchange(
    a: DataFrame,
    b: DataFrame,
    log_a: DataFrame,
    log_b: DataFrame,
    spec: TableSpec,
    *,
    applied_a: DataFrame | None = None,
    applied_b: DataFrame | None = None,
    conflict: str = "later",
    hashed: bool = False,
) -> Exchange:
    """Decide what goes from ``a`` (source names) to ``b`` (target names) and back.

    ``applied_a`` holds the rows that earlier cycles wrote to ``a`` on behalf of
    ``b``; their echoes in ``log_a`` are not sent back. Likewise ``applied_b``.
    A key changed on both sides goes one way only, see :func:`find_conflicts`.
    """
    back = spec.reversed()
    pk = spec.target_pk
    log_a = log_a.where(same_table(spec.source))
    log_b = log_b.where(same_table(spec.target))
    spark = log_a.sparkSession

    def pending(log: DataFrame, applied: DataFrame | None, one: TableSpec) -> DataFrame:
        own = log
        if applied is not None:
            own = suppress_echo(log, applied, hashed=hashed, fields=one.fields)
        return settle(pending_keys(own, one))

    both = [(log_a, applied_a, spec), (log_b, applied_b, back)]
    from_a, from_b = side_by_side(spark, lambda args: pending(*args), both)
    same_names = dict(zip(spec.pk, spec.target_pk, strict=True))
    met = find_conflicts(from_a, from_b.withColumnsRenamed(same_names), pk, conflict)

    lost_a = met.where(F.col("winner") == "target").select(*pk)
    lost_b = met.where(F.col("winner") == "source").select(
        *[F.col(t).alias(s) for s, t in same_names.items()]
    )
    both = [
        (a, from_a.join(lost_a, pk, "left_anti"), spec),
        (b, from_b.join(lost_b, spec.pk, "left_anti"), back),
    ]
    (to_b, bad_b), (to_a, bad_a) = side_by_side(
        spark, lambda args: decide_typed(*args, settled=True), both
    )
    return Exchange(to_a, to_b, met, bad_a, bad_b)


def two_way(
    a: DataFrame,
    b: DataFrame,
    log_a: DataFrame,
    log_b: DataFrame,
    spec: TableSpec,
    *,
    applied_a: DataFrame | None = None,
    applied_b: DataFrame | None = None,
    conflict: str = "later",
    hashed: bool = False,
) -> TwoWay:
    """Bring ``a`` and ``b`` in step: :func:`exchange`, then apply both ways."""
    plan = exchange(
        a,
        b,
        log_a,
        log_b,
        spec,
        applied_a=applied_a,
        applied_b=applied_b,
        conflict=conflict,
        hashed=hashed,
    )
    new_b, on_b = apply_from_peer(b, plan.to_b, spec.source, spec, skip_unchanged=hashed)
    new_a, on_a = apply_from_peer(
        a, plan.to_a, spec.target, spec.reversed(), skip_unchanged=hashed
    )
    return TwoWay(new_a, new_b, plan.conflicts, on_a, on_b)
