"""Session settings every operator relies on, scratch tables and small local frames."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from typing import Any

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tables worked on side by side.
PARALLEL = 8



class _Scope(list):
    """Paths to be removed when a block ends, and the scope around it."""

    outer: _Scope | None = None


_scope: ContextVar[_Scope | None] = ContextVar("scratch_scope", default=None)


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the operators count on: UTC timestamps, and TIME columns."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.timeType.enabled", "true")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Folder shared by driver and executors for scratch tables.

    The cluster names it in ``spark.checkpoint.dir``. Only where that setting
    is absent (single-machine tests) a temporary folder is used.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        # local-cluster has executors of its own, which share no temporary folder
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="rowtide-")
        context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the scratch folder."""
    return f"{scratch_root(spark).rstrip('/')}/rowtide/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, *, outlive: bool = False) -> DataFrame:
    """Write ``df`` once to a scratch table and read it back from there.

    Used where two passes must see the very same rows, or where something small
    that took a large scan to find is needed more than once. The rows are in
    shared storage, so losing an executor between the passes changes nothing, and
    their true size is known when joins are planned. What is to ``outlive`` the innermost
    :func:`scratch_scope` is removed by the one around it, if there is one.
    """
    path = _noted_path(df.sparkSession, outlive=outlive)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _noted_path(spark: SparkSession, *, outlive: bool = False) -> str:
    """A new scratch path that the scope knows of."""
    path, scope = scratch_path(spark, "settled"), _scope.get()
    if scope is not None and outlive:
        scope = scope.outer
    if scope is not None:
        scope.append(path)
    return path


def settle_parted(df: DataFrame, column: str) -> DataFrame:
    """:func:`settle` with one folder per value of ``column`` (a string, few values).

    Reading one value afterwards opens its folder only.
    """
    spark = df.sparkSession
    path = _noted_path(spark)
    df.write.partitionBy(column).parquet(path)
    kept = [f for f in df.schema.fields if f.name != column]
    schema = T.StructType([*kept, df.schema[column]])
    return spark.read.schema(schema).parquet(path).select(*df.columns)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove the scratch tables written inside the block when it ends.

    For drivers, whose results are committed by then. Outside such a block they
    stay, like checkpoint files, until the folder is cleaned.
    """
    paths = _Scope()
    paths.outer = _scope.get()
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
        context = spark.sparkContext
        for name in paths:
            path = context._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def side_by_side(
    spark: SparkSession, work: Callable[[Any], Any], items: Iterable[Any]
) -> list[Any]:
    """Results of ``work`` for every item, run in parallel; all end before an error is raised.

    Spark shares the cluster between the jobs that the calls start.
    """
    call = inheritable_thread_target(spark)(work)
    with ThreadPoolExecutor(PARALLEL) as pool:
        # each in a copy of this context, so that its scratch tables are removed, too
        futures = [pool.submit(copy_context().run, call, item) for item in items]
    return [f.result() for f in futures]


def small_frame(spark: SparkSession, rows: Sequence[Sequence[Any]], schema: str) -> DataFrame:
    """A few driver-side rows as a local relation, known to the planner by size."""
    if not rows:
        return empty_frame(spark, schema)
    names = T.StructType.fromDDL(schema).names
    data = pa.Table.from_pylist([dict(zip(names, row, strict=True)) for row in rows])
    return spark.createDataFrame(data, schema)


def empty_frame(spark: SparkSession, schema: str) -> DataFrame:
    """No rows of the given columns; joins with it are planned away."""
    fields = T.StructType.fromDDL(schema)
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
