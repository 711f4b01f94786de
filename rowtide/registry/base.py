"""Registered queries: a Spark callable and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated function under ``name``."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, run, sql)
        return run

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def rows(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    """Run SQL over the base tables it names."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            table(spark, sf, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def with_tables(sql: str, **parts: str) -> str:
    """SQL with named subqueries put in front."""
    head = ", ".join(f"{name} AS ({body})" for name, body in parts.items())
    return f"WITH {head} {sql}"
