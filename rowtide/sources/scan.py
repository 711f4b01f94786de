"""Reading the mapped part of a table."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.plans.spec import FieldSpec, TableSpec


def project(df: DataFrame, fields: Sequence[FieldSpec], *, reverse: bool = False) -> DataFrame:
    """Rename mapped columns from source to target names, or back with ``reverse``."""
    if reverse:
        return df.select(*[F.col(f.target).alias(f.source) for f in fields])
    return df.select(*[F.col(f.source).alias(f.target) for f in fields])


def scan(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The mapped columns of a source table, and nothing else, under their source names."""
    spec.check(df)
    return df.select(*[f.source for f in spec.fields])


def scan_flagged(df: DataFrame, flag: str, before: Any) -> DataFrame:
    """Rows whose flag still has its *before* value."""
    return df.where(F.col(flag) == F.lit(before))


def scan_time_range(df: DataFrame, ts: str, lo: Column | Any, hi: Column | Any) -> DataFrame:
    """Rows with ``lo <= ts < hi``; half open, so neighbouring ranges never share a row."""
    return df.where((F.col(ts) >= _bound(lo)) & (F.col(ts) < _bound(hi)))


def _bound(value: Any) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.to_timestamp_ntz(F.lit(value))
    return F.lit(value)


def fetch_by_keys(source: DataFrame, keys: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Current source rows for the given keys; a key asked for often is fetched once."""
    return source.join(keys.select(*pk).distinct(), list(pk), "left_semi")


def source_count(df: DataFrame, predicate: Column | None = None) -> DataFrame:
    """Number of rows, whole or filtered, as one row ``n``."""
    chosen = df if predicate is None else df.where(predicate)
    return chosen.agg(F.count(F.lit(1)).alias("n"))


_V1 = "spark.sql.sources.useV1SourceList"


def footer_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table whose counts, and bounds of numbers and dates, are answered from file footers.

    Read through the newer source interface, which takes whole aggregates; a filter on
    anything but a partition column makes Spark read the rows again.
    """
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    kept = spark.conf.get(_V1)
    spark.conf.set(_V1, ",".join(name for name in kept.split(",") if name != "parquet"))
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set(_V1, kept)


def marker_bounds(df: DataFrame, ts: str) -> DataFrame:
    """Earliest and latest value of a marker column, as one row ``lo, hi``."""
    return df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))


def read_sequences(catalog: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Sequence catalog rows, by upper-case name when ``names`` is given."""
    rows = catalog.select(
        "sequence_owner", "sequence_name", "last_number", "increment_by", "cache_size"
    )
    if names is None:
        return rows
    return rows.where(F.upper("sequence_name").isin([n.upper() for n in names]))
