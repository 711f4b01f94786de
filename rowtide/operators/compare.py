"""Comparing a source with a target by key."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtide.session import settle


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def has_key(pk: Sequence[str]) -> Column:
    """True where no key column is NULL."""
    return all_of([F.col(c).isNotNull() for c in pk])


def with_presence(
    df: DataFrame, other: DataFrame, pk: Sequence[str], yes: str, no: str, out: str
) -> DataFrame:
    """Add ``out``: ``yes`` where ``other`` holds a row with this row's key, else ``no``.

    Planned as an existence join, which needs one row per key on neither side.
    """
    # the outer row is named apart, or its key would be taken for that of ``other``
    here = f"_outer_{uuid.uuid4().hex}"
    keys = other.select(*[F.col(c).alias(f"_key_{i}") for i, c in enumerate(pk)])
    same = [F.col(f"_key_{i}") == F.col(f"{here}.{c}").outer() for i, c in enumerate(pk)]
    found = keys.where(all_of(same)).exists()
    return df.alias(here).select("*", F.when(found, yes).otherwise(no).alias(out))


def classify(
    source: DataFrame, target: DataFrame, pk: Sequence[str], *, only_changed: bool = False
) -> DataFrame:
    """Add ``op`` to every source row: I if the target lacks its key, else U.

    Values are compared only with ``only_changed``: then rows the target already
    holds in the same form get ``=`` (NULL equals NULL). The target has one row
    per key, as a keyed table does.
    """
    if not only_changed:
        return with_presence(source, target, pk, "U", "I", "op")
    values = [c for c in source.columns if c not in pk]
    old = target.select(
        *pk, F.struct(F.lit(True).alias("_"), *[F.col(c) for c in values]).alias("_old")
    )
    same = all_of([F.lit(True), *[F.col(c).eqNullSafe(F.col(f"_old.{c}")) for c in values]])
    op = F.when(F.col("_old").isNull(), "I").when(same, "=").otherwise("U")
    return source.join(old, list(pk), "left").select(*source.columns, op.alias("op"))


def inserts(source: DataFrame, target: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Source rows whose key the target lacks."""
    return source.join(target.select(*pk), list(pk), "left_anti")


def updates(source: DataFrame, target: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Source rows whose key the target holds."""
    return source.join(target.select(*pk), list(pk), "left_semi")


def dedupe(
    df: DataFrame, pk: Sequence[str], order_by: Sequence[str], *, latest: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Split ``df`` into one row per key and the rows turned away.

    The smallest row by ``order_by`` is kept (the largest with ``latest``); the
    remaining columns break ties. Rows without a key are all turned away. A
    rejected row carries ``copies``, the number of times it occurred, so a
    million equal copies stay one row.

    Both sides are aggregates, so a key that holds a third of the data shrinks
    before it is shuffled, and rejects are grouped by whole rows, which spreads
    even such a key over all tasks.
    """
    columns = df.columns
    first = [*order_by, *[c for c in columns if c not in order_by and c not in pk]]
    pick = F.max if latest else F.min
    kept = (
        df.where(has_key(pk))
        .groupBy(*pk)
        .agg(pick(F.struct(*first)).alias("_row") if first else F.lit(None).alias("_row"))
        # keys come from the grouping, so a caller that wants only keys pays only for those
        .select(*[c if c in pk else F.col(f"_row.{c}").alias(c) for c in columns])
    )
    # every row counts +1 and every kept row -1: what is left over was turned away
    rejected = (
        df.withColumn("copies", F.lit(1).cast("long"))
        .unionByName(kept.withColumn("copies", F.lit(-1).cast("long")))
        .groupBy(*columns)
        .agg(F.sum("copies").alias("copies"))
        .where(F.col("copies") > 0)
    )
    return kept, rejected


def dedupe_rare(
    df: DataFrame, pk: Sequence[str], order_by: Sequence[str], *, latest: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Same outcome as :func:`dedupe`, for tables in which few keys occur more than once.

    Counting keys shuffles nothing but keys. The few that occur again are settled,
    so their size is known and they are broadcast where that is cheap; all other
    rows pass without being sorted or shuffled here.
    """
    keyed = df.where(has_key(pk))
    count = F.count(F.lit(1))
    again = settle(keyed.groupBy(*pk).agg(count.alias("_n")).where("_n > 1").select(*pk))
    unique = keyed.join(again, list(pk), "left_anti").select(*df.columns)
    doubled = keyed.join(again, list(pk), "left_semi").select(*df.columns)
    kept, rejected = dedupe(doubled, pk, order_by, latest=latest)
    keyless = df.where(~has_key(pk)).groupBy(*df.columns).agg(count.alias("copies"))
    return unique.unionByName(kept), rejected.unionByName(keyless)
