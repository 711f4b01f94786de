"""Reading and writing databases through Spark's JDBC source.

Spark's own dialects render the SQL for each vendor. Predicates and column lists
put on the returned DataFrame are pushed into the database.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from rowtide.sources.snapshots import SnapshotStore


@dataclass(frozen=True)
class Connection:
    """A named database. Credentials come from the caller, never from this package."""

    url: str
    properties: dict[str, str] = field(default_factory=dict)

    def options(self, **extra: object) -> dict[str, str]:
        return {"url": self.url, **self.properties, **{k: str(v) for k, v in extra.items()}}


def read_options(
    conn: Connection,
    table: str,
    *,
    key: str | None = None,
    bounds: tuple[object, object] | None = None,
    partitions: int = 1,
    fetchsize: int = 10_000,
) -> dict[str, str]:
    """Options of a read that opens one connection per partition of the key range."""
    options = conn.options(dbtable=table, fetchsize=fetchsize)
    if key is not None and partitions > 1 and bounds is not None and bounds[0] is not None:
        options |= {
            "partitionColumn": key,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc(
    spark: SparkSession,
    conn: Connection,
    table: str,
    *,
    key: str | None = None,
    partitions: int = 1,
    fetchsize: int = 10_000,
) -> DataFrame:
    """A database table; with a numeric, date or timestamp ``key`` read in parallel ranges.

    The range is asked from the database first (one row). Rows outside it still
    fall into the first or last partition, so none is lost.
    """
    bounds = None
    if key is not None and partitions > 1:
        query = f"select min({key}) as lo, max({key}) as hi from {table}"
        row = spark.read.format("jdbc").options(**conn.options(query=query)).load().first()
        bounds = (row[0], row[1])
    options = read_options(
        conn, table, key=key, bounds=bounds, partitions=partitions, fetchsize=fetchsize
    )
    return spark.read.format("jdbc").options(**options).load()


def append_jdbc(df: DataFrame, conn: Connection, table: str, *, batchsize: int = 10_000) -> None:
    """Insert rows in batches, one connection per partition."""
    options = conn.options(dbtable=table, batchsize=batchsize)
    df.write.format("jdbc").options(**options).mode("append").save()


def replace_jdbc(df: DataFrame, conn: Connection, table: str, *, batchsize: int = 10_000) -> None:
    """Replace the contents of a table, keeping its definition.

    Spark's writer can only append or overwrite, so an upsert or delete in a
    database means writing the whole new state. ``df`` must not read from
    ``table`` itself: commit the state to a snapshot table first and pass that.
    Truncating and inserting is not one transaction; a failure leaves a partial
    table, to be repaired by running the call again.
    """
    options = conn.options(dbtable=table, batchsize=batchsize, truncate="true")
    df.write.format("jdbc").options(**options).mode("overwrite").save()


def pull(
    store: SnapshotStore, conn: Connection, tables: Mapping[str, str | None], *, partitions: int = 1
) -> None:
    """Copy database tables (name to the key their reading is split by) into a store, all at once."""
    store.commit(
        {
            name: read_jdbc(store.spark, conn, name, key=key, partitions=partitions)
            for name, key in tables.items()
        }
    )


def push(store: SnapshotStore, conn: Connection, tables: Mapping[str, str]) -> None:
    """Write committed tables of a store (name to database table) back to a database.

    A version never changes once it is published, so what is written cannot depend
    on the database tables that are being replaced.
    """
    for name, table in tables.items():
        replace_jdbc(store.read(name), conn, table)
