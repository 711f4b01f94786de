"""Reading one page of a large table without numbering its rows.

An index says how many rows lie in each of some thousand key ranges. Its bounds are quantiles
of a sample of keys, drawn by the order of their hashes, so that it is the same whenever
it is drawn; the rows of every range are counted, all of them, in one pass over the key. A page
is found by searching the sums of these counts; only the ranges it lies in are read, by
bounds that reach the files, and only their rows are sorted.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowtide.session import empty_frame

# Ranges of an index (a power of two), and keys drawn for each bound.
RANGES = 1024
DRAWN = 16


@dataclass(frozen=True)
class PageIndex:
    """Bounds of key ranges, each but the first beginning with one, and the rows before each range."""

    keys: tuple[str, ...]
    bounds: tuple[tuple[Any, ...], ...]
    before: tuple[int, ...]

    @property
    def rows(self) -> int:
        return self.before[-1]

    def pages(self, page_size: int) -> int:
        return -(-self.rows // page_size)


def _literal(bound: Sequence[Any], df: DataFrame, keys: Sequence[str]) -> Column:
    cells = zip(keys, bound, strict=True)
    return F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in cells])


def _range_of(df: DataFrame, keys: Sequence[str], bounds: Sequence[tuple], ranges: int) -> Column:
    """How many bounds are not above the key, by binary search."""
    if not bounds:
        return F.lit(0)
    listed = F.array(*[_literal(b, df, keys) for b in bounds])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(ranges.bit_length() - 1))])
    key = F.struct(*keys)

    def step(low: Column, size: Column) -> Column:
        # past the last bound there is none to compare with: NULL, so not taken
        bound = F.get(listed, low + size - 1)
        return F.when(bound.isNotNull() & (bound <= key), low + size).otherwise(low)

    return F.aggregate(steps, F.lit(0), step)


def page_index(df: DataFrame, keys: Sequence[str], *, ranges: int = RANGES) -> PageIndex:
    """Index of a table by its unique ``keys``, in their order, nulls first."""
    if ranges & (ranges - 1):
        raise ValueError("ranges must be a power of two")
    keys = tuple(keys)
    named = [F.col(k) for k in keys]
    drawn = df.select(*named).orderBy(F.xxhash64(*named), *named).limit(ranges * DRAWN)
    sample = [tuple(r) for r in drawn.orderBy(*named).collect()]
    step = max(1, len(sample) // ranges)
    bounds = tuple(dict.fromkeys(sample[step::step][: ranges - 1]))
    counts = df.select(*named).groupBy(_range_of(df, keys, bounds, ranges).alias("r")).count().collect()
    found = {r["r"]: r["count"] for r in counts}
    sizes = [found.get(i, 0) for i in range(len(bounds) + 1)]
    return PageIndex(keys, bounds, tuple(accumulate(sizes, initial=0)))


def _between(df: DataFrame, index: PageIndex, first: int, last: int) -> DataFrame:
    """Rows of the ranges ``first`` to ``last``; bounds of the first key column reach the files."""
    key, lead = F.struct(*index.keys), index.keys[0]
    if first > 0:
        low = index.bounds[first - 1]
        df = df.where(key >= _literal(low, df, index.keys))
        if low[0] is not None:
            df = df.where(F.col(lead) >= F.lit(low[0]).cast(df.schema[lead].dataType))
    if last < len(index.bounds):
        high = index.bounds[last]
        df = df.where(key < _literal(high, df, index.keys))
        if first > 0 and index.bounds[first - 1][0] is not None and high[0] is not None:
            df = df.where(F.col(lead) <= F.lit(high[0]).cast(df.schema[lead].dataType))
    return df


def read_page(df: DataFrame, index: PageIndex, page_no: int, page_size: int) -> DataFrame:
    """Page ``page_no`` (from 1) in key order, with ``row_no`` and ``page_no`` as ``paginate`` has them.

    No rows beyond the last page. The table must be the one that was indexed.
    """
    start, end = (page_no - 1) * page_size, min(page_no * page_size, index.rows)
    if page_no < 1 or start >= end:
        names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return empty_frame(df.sparkSession, f"{names}, row_no bigint, page_no bigint")
    first = bisect_right(index.before, start) - 1
    last = bisect_right(index.before, end - 1) - 1
    order = [F.col(k) for k in index.keys]
    rows = _between(df, index, first, last).orderBy(*order).offset(start - index.before[first]).limit(end - start)
    # the page is no longer than its size, and in order already
    place = F.row_number().over(Window.orderBy(*order))
    return rows.withColumn("row_no", (place + F.lit(start)).cast("long")).withColumn(
        "page_no", F.lit(page_no).cast("long")
    )
