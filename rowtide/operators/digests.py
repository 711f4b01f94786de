"""Comparing two snapshots by digests of key ranges, so that only ranges that differ are joined.

The rows of a key range are summed up to a digest that does not depend on their order: their
number, the sums of both halves of their hashes, and the xor of the hashes. Ranges
are put together to larger ranges, level by level, up to a few. Two snapshots are compared from
the top: below a range that agrees nothing is looked at. A tree is made by one narrow
aggregate; kept beside its snapshot, the next capture reads only the new snapshot for it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtide.operators.changelog import capture_changes
from rowtide.operators.compare import all_of
from rowtide.plans.spec import TableSpec
from rowtide.session import settle

# A range covers 2**SPAN_BITS values of an integer key (or 2**-HASH_BITS of all hashes of other
# keys), and 2**FAN_BITS ranges make a range of the next level.
SPAN_BITS = 10
HASH_BITS = 20
FAN_BITS = 8
LEVELS = 3
# Ranges that differ up to which their list is broadcast to the snapshots.
BROADCAST_RANGES = 1 << 18

# Fixed value: the range of rows without a key.
NO_RANGE = -(1 << 62)

_DIGEST = ["n", "low", "high", "x"]
_HALF = (1 << 32) - 1


def range_of(pk: Sequence[str], schema: T.StructType, span_bits: int = SPAN_BITS) -> Column:
    """The range of a row: spans of the first key column if it is an integer or a date, else of hashes."""
    kind = schema[pk[0]].dataType
    first = F.col(pk[0])
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        place = F.shiftright(first.cast("long"), span_bits)
    elif isinstance(kind, T.DateType):
        place = F.unix_date(first).cast("long")
    else:
        place = F.shiftright(F.xxhash64(*pk), 64 - HASH_BITS)
    return F.coalesce(place, F.lit(NO_RANGE))


@dataclass(frozen=True)
class DigestTree:
    """Digests per range (``range n low high x``), from the finest level to the coarsest."""

    pk: tuple[str, ...]
    columns: tuple[str, ...]
    span_bits: int
    levels: tuple[DataFrame, ...]

    def tables(self, name: str) -> dict[str, DataFrame]:
        """The levels under the names they are kept with, to be committed with their snapshot."""
        return {f"{name}__digest_{i}": level for i, level in enumerate(self.levels)}

    @staticmethod
    def kept(
        tables: Mapping[str, DataFrame], name: str, pk: Sequence[str], columns: Sequence[str],
        span_bits: int = SPAN_BITS, levels: int = LEVELS,
    ) -> DigestTree:
        """A tree that was kept with its snapshot."""
        found = tuple(tables[f"{name}__digest_{i}"] for i in range(levels))
        return DigestTree(tuple(pk), tuple(columns), span_bits, found)


def digest_tree(
    df: DataFrame,
    pk: Sequence[str],
    columns: Sequence[str],
    *,
    span_bits: int = SPAN_BITS,
    levels: int = LEVELS,
) -> DigestTree:
    """Digests of the ``columns`` (key included) of a snapshot; one pass over these columns."""
    # a hash passes over NULLs, so where they are is hashed, too
    hashed = F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])
    rows = df.select(range_of(pk, df.schema, span_bits).alias("range"), hashed.alias("_h"))
    finest = rows.groupBy("range").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("_h").bitwiseAND(F.lit(_HALF))).alias("low"),
        F.sum(F.shiftrightunsigned("_h", 32)).alias("high"),
        F.bit_xor("_h").alias("x"),
    )
    found = [settle(_folded(finest))]
    for _ in range(levels - 1):
        wider = found[-1].groupBy(F.shiftright("range", FAN_BITS).alias("range")).agg(
            *[F.sum(c).alias(c) for c in ("n", "low", "high")], F.bit_xor("x").alias("x")
        )
        found.append(settle(_folded(wider)))
    return DigestTree(tuple(pk), tuple(columns), span_bits, tuple(found))


def _folded(digests: DataFrame) -> DataFrame:
    """Sums of hashes modulo 2**32, so that no level overflows."""
    halves = {c: F.col(c).bitwiseAND(F.lit(_HALF)) for c in ("low", "high")}
    return digests.withColumns(halves).select("range", *_DIGEST)


def _listed(ranges: DataFrame) -> DataFrame:
    return F.broadcast(ranges) if ranges.count() <= BROADCAST_RANGES else ranges


def differing_ranges(before: DigestTree, after: DigestTree) -> DataFrame:
    """Finest ranges (``range``) in which the snapshots differ, found from the top down."""
    if (before.columns, before.span_bits, len(before.levels)) != (
        after.columns,
        after.span_bits,
        len(after.levels),
    ):
        raise ValueError("the digests are of different columns or ranges")
    wanted = None
    for old, new in zip(reversed(before.levels), reversed(after.levels), strict=True):
        if wanted is not None:
            above = _listed(wanted).withColumnRenamed("range", "_above")
            inside = F.shiftright("range", FAN_BITS) == F.col("_above")
            old, new = old.join(above, inside, "left_semi"), new.join(above, inside, "left_semi")
        new = new.select("range", *[F.col(c).alias(f"_{c}") for c in _DIGEST])
        same = all_of([F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _DIGEST])
        wanted = settle(old.join(new, "range", "full").where(~same).select("range"))
        if wanted.isEmpty():
            break
    return wanted


def rows_in(df: DataFrame, pk: Sequence[str], ranges: DataFrame, span_bits: int = SPAN_BITS) -> DataFrame:
    """Rows of the given ranges; while these are few they are broadcast, and nothing else is shuffled."""
    named = df.withColumn("_range", range_of(pk, df.schema, span_bits))
    listed = _listed(ranges).withColumnRenamed("range", "_range")
    return named.join(listed, "_range", "left_semi").select(*df.columns)


def capture_by_digest(
    before: DataFrame,
    after: DataFrame,
    spec: TableSpec,
    *,
    reverse: bool = False,
    trees: tuple[DigestTree | None, DigestTree | None] = (None, None),
    span_bits: int = SPAN_BITS,
    **options,
) -> DataFrame:
    """What :func:`~rowtide.operators.changelog.capture_changes` captures, joining only ranges that differ.

    ``trees`` are the digests of the two snapshots where they are known; others are made.
    Both snapshots must have the same column types.
    """
    side = "target" if reverse else "source"
    columns = [getattr(f, side) for f in spec.fields]
    pk = spec.target_pk if reverse else spec.pk
    old, new = before.select(*columns), after.select(*columns)
    if [f.dataType for f in old.schema] != [f.dataType for f in new.schema]:
        raise ValueError("the snapshots have different column types")
    made = [
        tree or digest_tree(df, pk, columns, span_bits=span_bits)
        for tree, df in zip(trees, (old, new), strict=True)
    ]
    ranges = differing_ranges(*made)
    old, new = (rows_in(df, pk, ranges, span_bits) for df in (old, new))
    return capture_changes(old, new, spec, reverse=reverse, **options)
