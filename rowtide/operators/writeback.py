"""Applying rows to a target. Every function returns the new state of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtide.operators.compare import inserts


def present_keys(target: DataFrame, keys: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Keys that the target holds.

    The possibly huge target is the probe side, so a small batch of keys is
    broadcast to it and the target is read in place, one column wide.
    """
    return target.select(*pk).join(keys.select(*pk).distinct(), list(pk), "left_semi")


def complete(rows: DataFrame, target: DataFrame, pk: Sequence[str]) -> DataFrame:
    """``rows`` with all columns of the target.

    Columns the mapping does not cover keep what the target holds for the key;
    they are NULL for a new key.
    """
    extra = [c for c in target.columns if c not in rows.columns]
    if extra:
        there = target.join(rows.select(*pk).distinct(), list(pk), "left_semi")
        rows = rows.join(there.select(*pk, *extra), list(pk), "left")
    return rows.select(*target.columns)


def append(
    target: DataFrame, rows: DataFrame, pk: Sequence[str], *, on_conflict: str = "reject"
) -> DataFrame:
    """Target plus the rows whose key it lacks (``"reject"``), or plus all (``"allow"``)."""
    if on_conflict == "allow":
        return target.unionByName(rows, allowMissingColumns=True)
    if on_conflict != "reject":
        raise ValueError(f"on_conflict: {on_conflict}")
    return target.unionByName(missing_rows(target, rows, pk), allowMissingColumns=True)


def missing_rows(target: DataFrame, rows: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Rows whose key the target lacks."""
    fresh = rows.join(present_keys(target, rows, pk), list(pk), "left_anti")
    return fresh.select(*rows.columns)


def conflicts(target: DataFrame, rows: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Rows that :func:`append` turns away."""
    return rows.join(present_keys(target, rows, pk), list(pk), "left_semi")


def update_by_key(target: DataFrame, rows: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Overwrite the columns ``rows`` brings where its key matches; NULL overwrites too."""
    values = [c for c in rows.columns if c not in pk]
    new = rows.select(
        *pk, F.struct(F.lit(True).alias("_"), *[F.col(c) for c in values]).alias("_new")
    )
    return target.join(new, list(pk), "left").select(
        *[
            F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
            if c in values
            else F.col(c)
            for c in target.columns
        ]
    )


def delete_by_key(target: DataFrame, keys: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Target without the rows named by ``keys``."""
    return inserts(target, keys, pk)


def upsert(target: DataFrame, rows: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Replace rows that are present by key, add those that are not."""
    kept = inserts(target, rows, pk).select(*target.columns)
    return kept.unionByName(complete(rows, target, pk))


def merge(
    target: DataFrame, rows: DataFrame, pk: Sequence[str], *, op: str | None = None
) -> DataFrame:
    """Same result as :func:`upsert`, for ``rows`` as large as the target.

    One full join by key: both sides are read and shuffled once, while
    :func:`upsert` reads ``rows`` twice but can broadcast them when they are few.
    ``rows`` must hold a key at most once. With ``op`` a column of that name says what
    became of each row: I, U, or null where nothing did.
    """

    def packed(df: DataFrame, name: str) -> DataFrame:
        cells = [F.col(c) for c in df.columns if c not in pk]
        return df.select(*pk, F.struct(F.lit(True).alias("_"), *cells).alias(name))

    def cell(c: str) -> Column:
        if c not in rows.columns:
            return F.col(f"_old.{c}").alias(c)
        new = F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}"))
        return new.otherwise(F.col(f"_old.{c}")).alias(c)

    both = packed(target, "_old").join(packed(rows, "_new"), list(pk), "full")
    brought, there = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    became = [] if op is None else [F.when(brought & there, "U").when(brought, "I").alias(op)]
    return both.select(*[c if c in pk else cell(c) for c in target.columns], *became)


def move(
    source: DataFrame, target: DataFrame, rows: DataFrame, pk: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Upsert ``rows`` into the target, then drop them at the source.

    Returns ``(target, source)``; write the target first.
    """
    return upsert(target, rows, pk), delete_by_key(source, rows, pk)


def flip_flag(
    source: DataFrame, copied: DataFrame, pk: Sequence[str], flag: str, after: int
) -> DataFrame:
    """Set ``flag`` to ``after`` on the source rows that were copied."""
    done = copied.select(*pk).distinct().withColumn("_done", F.lit(True))
    kind = source.schema[flag].dataType
    value = F.when(F.col("_done"), F.lit(after).cast(kind)).otherwise(F.col(flag))
    return source.join(done, list(pk), "left").select(
        *[value.alias(c) if c == flag else F.col(c) for c in source.columns]
    )

