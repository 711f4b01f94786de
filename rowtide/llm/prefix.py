"""Prefix sums over a total order, without one task seeing all rows.

Rows are range partitioned, summed up inside their partitions while they are written, and
offset by what lies in earlier partitions: one number per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtide.session import settle


def prefix_sums(df: DataFrame, order: Sequence[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` (a long) over all rows before, in ``order``.

    ``order`` should tell all rows apart, so that no range of equal rows meets in one task;
    what it does not tell apart comes in any order. Written once.
    """

    def cumulate(batches):
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            values = batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = before + np.cumsum(values)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(values), part, np.int32)), pa.array(ends - values)],
                [*batch.schema.names, "_part", "_inside"],
            )
            before = int(ends[-1]) if len(ends) else before

    fields = [*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_inside", T.LongType())]
    laid = settle(
        df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cumulate, T.StructType(fields))
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = laid.groupBy("_part").agg(F.max(F.col("_inside") + F.col(value)).alias("_sum"))
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    # one row per partition: always small
    return (
        laid.join(F.broadcast(offsets), "_part")
        .withColumn(out, (F.col("_offset") + F.col("_inside")).cast("long"))
        .drop("_part", "_inside", "_offset")
    )
