"""Numbering rows in a total order without one task seeing all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtide.session import settle

# A bucket covers 2**20 consecutive integer ids. Ids are unique, so this is also
# the most rows a bucket can hold, whatever the data looks like. Summaries of buckets
# are put together in levels, each of 2**22 numbers, so that no task gets more summary
# rows than that, however sparse the ids are.
BUCKET_BITS = 20
LEVEL_BITS = 22

_NARROW = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)

# The buckets of rows without an id, below all others.
NO_ID = -(1 << 62)
NO_ID_BUCKETS = 1024


def bucket_of(order: str, bits: int = BUCKET_BITS, spread: Sequence[str] = ()) -> Column:
    """Bucket of an integer column: equal spans of ``2**bits`` ids, in id order.

    Rows without an id, which have no order, are spread by the columns ``spread``.
    """
    none = F.lit(NO_ID)
    if spread:
        none = none + F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(NO_ID_BUCKETS))
    return F.coalesce(F.shiftright(F.col(order).cast("long"), bits), none)


def upper_levels(bits: int = BUCKET_BITS) -> int:
    """How many levels of parents lie above buckets of ``bits`` until few numbers are left."""
    return max(0, -(-(64 - bits) // LEVEL_BITS) - 1)


# Rows of a bucket, about, and buckets of a table, while buckets need not be larger.
BUCKET_ROWS = 1 << 12
BUCKETS = 64


def fitting_bits(df: DataFrame, order: str) -> tuple[int, int]:
    """Bits of the buckets of a table, and levels of parents above them, by its rows and range of ids.

    One pass over the ids. Small tables get buckets enough to keep several tasks busy; none is
    larger than ``2**BUCKET_BITS`` ids. Numbers do not depend on how they are cut.
    """
    n, low, high = df.agg(F.count(order), F.min(order), F.max(order)).first()
    if not n:
        return BUCKET_BITS, 0
    width = int(high) - int(low) + 1
    ids = max(BUCKET_ROWS, n // BUCKETS) * width // n
    bits = max(0, min(BUCKET_BITS, ids.bit_length() - 1))
    return bits, max(0, -(-((width >> bits).bit_length() - LEVEL_BITS) // LEVEL_BITS))


def parent_of(bucket: str = "_bucket") -> Column:
    return F.shiftright(F.col(bucket), LEVEL_BITS)


def earlier_sums(
    counts: DataFrame, group: Sequence[str] = (), *, value: str = "_rows", levels: int = upper_levels()
) -> DataFrame:
    """``group, _bucket, _before``: the sum of ``value`` over all earlier buckets of the group.

    ``counts`` has one row per group and bucket. Sums are made inside each parent of
    neighbouring buckets, and what lies before the parent is found in the same way.
    """
    keys = [F.col(c) for c in group]
    if levels == 0:
        before = Window.partitionBy(*keys).orderBy("_bucket")
    else:
        counts = counts.withColumn("_parent", parent_of())
        before = Window.partitionBy(*keys, "_parent").orderBy("_bucket")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(value).over(before), F.lit(0).cast("long"))
    if levels == 0:
        return counts.select(*keys, "_bucket", inside.alias("_before"))
    parents = counts.groupBy(*keys, "_parent").agg(F.sum(value).alias(value))
    above = earlier_sums(
        parents.withColumnRenamed("_parent", "_bucket"), group, value=value, levels=levels - 1
    ).withColumnsRenamed({"_bucket": "_parent", "_before": "_above"})
    return (
        counts.select(*keys, "_bucket", "_parent", inside.alias("_inside"))
        .join(above, [*group, "_parent"])
        .select(*keys, "_bucket", (F.col("_inside") + F.col("_above")).alias("_before"))
    )


def number_rows(
    df: DataFrame,
    order_by: Sequence[str],
    *,
    out: str = "row_no",
    bits: int | None = None,
) -> DataFrame:
    """Add ``out`` = 1, 2, 3 ... in the order of ``order_by``, a unique key of ``df``.

    A single integer key is cut into id buckets (of ``2**bits`` ids, or as many as fit the
    table): rows are counted per bucket, the counts summed up to offsets, and each
    bucket numbered on its own. Other keys
    are range partitioned on the sampled key order instead; that layout is
    written down once so that counting and numbering see the same partitions.
    """
    order = list(order_by)
    kinds = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)
    if len(order) == 1 and isinstance(df.schema[order[0]].dataType, kinds):
        return _number_by_bucket(df, order[0], out, bits)
    return _number_by_range(df, order, out)


def _number_by_bucket(df: DataFrame, key: str, out: str, bits: int | None) -> DataFrame:
    bits, levels = fitting_bits(df, key) if bits is None else (bits, upper_levels(bits))
    # rows without an id are spread by a narrow column or two: counting reads those, too
    narrow = [f.name for f in df.schema if f.name != key and isinstance(f.dataType, _NARROW)]
    tagged = df.withColumn("_bucket", bucket_of(key, bits, narrow[:2]))
    counts = tagged.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    return (
        tagged.withColumn("_inside", inside)
        .join(earlier_sums(counts, levels=levels), "_bucket")
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_bucket", "_inside", "_before")
    )


def _number_by_range(df: DataFrame, order: list[str], out: str) -> DataFrame:
    # all other columns break ties, so equal keys may still spread over partitions
    rest = [
        f.name
        for f in df.schema
        if f.name not in order and not isinstance(f.dataType, (T.MapType, T.VariantType))
    ]
    laid_out = settle(
        df.repartitionByRange(*order, *rest)
        .sortWithinPartitions(*order, *rest)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    # the id holds the partition in its upper 31 bits and the place in the lower 33
    part = F.shiftright("_at", 33)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        laid_out.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    # one row per partition of the layout: always small enough to broadcast
    return (
        laid_out.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + place)
        .drop("_part", "_at", "_offset")
    )


def paginate(df: DataFrame, keys: Sequence[str], page_size: int, **options) -> DataFrame:
    """Add ``row_no`` in key order and ``page_no``, both counted from 1."""
    numbered = number_rows(df, keys, **options)
    page = F.floor((F.col("row_no") - 1) / F.lit(page_size)) + 1
    return numbered.withColumn("page_no", page.cast("long"))


def page_count(count: Column, size: int) -> Column:
    """Pages needed for ``count`` rows."""
    return F.ceil(count / F.lit(size)).cast("long")
