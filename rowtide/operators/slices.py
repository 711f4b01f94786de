"""Cutting a time range into fixed slices that are copied once complete."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: seconds per slice.
SLICE_SECONDS = 60


def _micros_between(first: Column, last: Column) -> Column:
    """Microseconds from one zoneless timestamp to another, whatever the session time zone."""
    gap = last - first
    whole = (
        F.extract(F.lit("DAY"), gap).cast("long") * 86_400
        + F.extract(F.lit("HOUR"), gap) * 3_600
        + F.extract(F.lit("MINUTE"), gap) * 60
    )
    seconds = F.extract(F.lit("SECOND"), gap)
    return whole * 1_000_000 + (seconds * 1_000_000).cast("long")


def _after(first: Column, slices: Column, seconds: int) -> Column:
    """The moment ``slices`` slices after ``first``."""
    return first + F.make_dt_interval(secs=(slices * seconds).cast("decimal(18,6)"))


def _moment(value: datetime) -> Column:
    """A zoneless literal; as text it does not depend on any time zone on its way."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


# Fixed value: a range that holds no row.
NOTHING = (datetime(1970, 1, 1), datetime(1970, 1, 1))


def complete_range(
    df: DataFrame, ts: str, start: datetime | None = None, seconds: int = SLICE_SECONDS
) -> tuple[datetime, datetime] | None:
    """Where the complete slices begin and end; None while there is none.

    Slices are counted from ``start`` (the saved checkpoint), or from the earliest
    value when there is none. The last slice waits until a later row shows that it is
    complete: its end lies before the latest value. Runs one aggregate over the column.
    """
    marker = F.col(ts).cast("timestamp_ntz")
    lo, hi = df.agg(F.min(marker), F.max(marker)).first()
    lo = lo if start is None else start
    if lo is None or hi is None:
        return None
    slices = (hi - lo - timedelta(microseconds=1)) // timedelta(seconds=seconds)
    return (lo, lo + slices * timedelta(seconds=seconds)) if slices > 0 else None


def rows_between(df: DataFrame, ts: str, bounds: tuple[datetime, datetime] | None) -> DataFrame:
    """Rows of a half-open range; the limits are literals that reach the files."""
    lo, hi = map(_moment, bounds or NOTHING)
    return df.where((F.col(ts) >= lo) & (F.col(ts) < hi))


def rows_before(df: DataFrame, ts: str, moment: datetime) -> DataFrame:
    """Rows stamped before a moment."""
    return df.where(F.col(ts) < _moment(moment))


def digests_before(
    df: DataFrame, columns: Sequence[str], ts: str, moments: Sequence[datetime]
) -> list[tuple[int, int]]:
    """For each moment a digest of the rows before it: their number and the xor of their hashes.

    One narrow pass; two looks with the same digest have seen the same rows.
    """
    hashed = F.xxhash64(*columns)
    parts = []
    for i, moment in enumerate(moments):
        before = F.col(ts) < _moment(moment)
        parts += [F.count(F.when(before, 1)).alias(f"n{i}"), F.bit_xor(F.when(before, hashed)).alias(f"x{i}")]
    row = df.agg(*parts).first()
    return [(row[f"n{i}"], row[f"x{i}"] or 0) for i in range(len(moments))]


def time_slices(
    df: DataFrame, ts: str, start: datetime | None = None, seconds: int = SLICE_SECONDS
) -> DataFrame:
    """Rows of complete slices, with ``slice_no`` (from 0), ``slice_start`` and ``slice_end``.

    See :func:`complete_range` for which slices are complete. Rows before ``start`` were
    handled earlier; rows without a marker belong to no slice.
    """
    bounds = complete_range(df, ts, start, seconds)
    first = _moment((bounds or NOTHING)[0])
    width = F.lit(seconds * 1_000_000).cast("long")
    number = F.floor(_micros_between(first, F.col(ts)) / width).cast("long")
    return (
        rows_between(df, ts, bounds)
        .withColumn("slice_no", number)
        .withColumn("slice_start", _after(first, F.col("slice_no"), seconds))
        .withColumn("slice_end", _after(first, F.col("slice_no") + 1, seconds))
    )


def next_position(
    df: DataFrame, ts: str, start: datetime | Column | None = None, seconds: int = SLICE_SECONDS
) -> DataFrame:
    """Where the next cycle starts: the end of the last complete slice, as one row ``value``.

    Slices without rows count, too. NULL while no slice is complete.
    """
    if start is None:
        rows, first = df, F.min(ts)
    else:
        first = start if isinstance(start, Column) else F.lit(start).cast("timestamp_ntz")
        rows = df.where(F.col(ts) >= first)
        first = F.min(first)
    bounds = rows.agg(first.alias("lo"), F.max(ts).alias("hi"))
    width = F.lit(seconds * 1_000_000).cast("long")
    gap = _micros_between(F.col("lo"), F.col("hi"))
    complete = F.floor((gap - 1) / width).cast("long")
    end = _after(F.col("lo"), F.col("complete"), seconds)
    return bounds.withColumn("complete", complete).select(
        F.when(F.col("complete") > 0, end).alias("value")
    )
