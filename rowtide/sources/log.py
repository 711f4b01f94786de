"""The change log: ``id, dbname, tablename, pks, op, op_time``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.session import settle_parted

# Columns of the change log.
LOG_COLUMNS = ["id", "dbname", "tablename", "pks", "op", "op_time"]
LOG_SCHEMA = (
    "id bigint, dbname string, tablename string, pks string, op string, op_time timestamp_ntz"
)


def same_table(name: str) -> Column:
    """Log rows of one table; logs name tables in upper case, specs may not."""
    return F.upper("tablename") == F.lit(name.upper())


def read_log(log: DataFrame, *, table: str | None = None, limit: int | None = None) -> DataFrame:
    """Pending log rows in id order, of one table or all tables mixed.

    With ``limit`` only the first ``limit`` rows are taken (a top-N, never a
    full sort). Without it the rows come unordered: replay does not need order.
    """
    pending = log.where(F.col("id") > 0)
    if table is not None:
        pending = pending.where(same_table(table))
    return pending if limit is None else pending.orderBy("id").limit(limit)


# Partition column of a log that has been routed.
ROUTE = "_route"


def route_log(log: DataFrame) -> DataFrame:
    """The log read once and written by table, for jobs that look at each table's rows several times."""
    return settle_parted(log.withColumn(ROUTE, F.upper("tablename")), ROUTE)


def routed_to(routed: DataFrame, table: str) -> DataFrame:
    """One table's rows of a routed log; only their folder is read."""
    return routed.where(F.col(ROUTE) == F.lit(table.upper())).drop(ROUTE)


def read_log_stream(
    spark: SparkSession,
    path: str,
    schema: str = LOG_SCHEMA,
    *,
    fmt: str = "parquet",
    max_files: int | None = None,
    glob: str | None = None,
) -> DataFrame:
    """A folder that receives log files, as a stream; ``max_files`` bounds a batch."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def ack_log(log: DataFrame, acked: DataFrame) -> DataFrame:
    """Log rows still pending once exactly the ``(tablename, id)`` pairs in ``acked`` are done."""
    done = acked.select(F.upper("tablename").alias("_table"), F.col("id").alias("_id"))
    return log.join(
        done, (F.upper("tablename") == F.col("_table")) & (F.col("id") == F.col("_id")), "left_anti"
    )
