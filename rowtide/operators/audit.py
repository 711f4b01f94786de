"""Audit rows: how many changes a job made, and what it could not apply."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.functions.keys import encode_pks
from rowtide.operators.compare import all_of
from rowtide.operators.writeback import upsert
from rowtide.plans.spec import SyncJob, TableSpec
from rowtide.session import small_frame

# Key columns and column order of the two audit tables.
FLUX_KEY = [
    "business_name",
    "source_jdbc_name",
    "source_table_name",
    "target_jdbc_name",
    "target_table_name",
]
FLUX_COLUMNS = [*FLUX_KEY, "cycle", "count_i", "count_d", "count_u", "flag"]
ERROR_COLUMNS = [
    "log_time",
    "level",
    "business_name",
    "source_jdbc_name",
    "source_table_name",
    "target_jdbc_name",
    "target_table_name",
    "pk_value",
    "audit_error",
    "operator",
    "flag",
]


def _pair(job: SyncJob, spec: TableSpec) -> list[Column]:
    return [
        F.lit(job.name).alias("business_name"),
        F.lit(job.source_db).alias("source_jdbc_name"),
        F.lit(spec.source).alias("source_table_name"),
        F.lit(job.target_db).alias("target_jdbc_name"),
        F.lit(spec.target).alias("target_table_name"),
    ]


def flux(changes: DataFrame, by: Sequence[str], *, op: str = "op") -> DataFrame:
    """Inserts, deletes and updates counted per ``by``."""
    count = lambda letter: F.count(F.when(F.col(op) == letter, 1))
    return changes.groupBy(*by).agg(
        count("I").alias("count_i"), count("D").alias("count_d"), count("U").alias("count_u")
    )


def job_flux(changes: DataFrame, job: SyncJob, spec: TableSpec, cycle: int = 1) -> DataFrame:
    """One audit row for a table of a job; ``changes`` carries ``op``."""
    counts = flux(changes, [])
    return counts.select(
        *_pair(job, spec),
        F.lit(cycle).alias("cycle"),
        "count_i",
        "count_d",
        "count_u",
        F.lit(0).alias("flag"),
    )


def counted_flux(
    spark: SparkSession, counts: Mapping[str, int], job: SyncJob, spec: TableSpec, cycle: int = 1
) -> DataFrame:
    """The audit row of a table of a job from counts made while it was written."""
    found = {f"count_{letter}": int(counts.get(f"count_{letter}", 0)) for letter in "idu"}
    pair = (job.name, job.source_db, spec.source, job.target_db, spec.target)
    names = ", ".join(f"{c} string" for c in FLUX_KEY)
    schema = f"{names}, cycle int, count_i bigint, count_d bigint, count_u bigint, flag int"
    return small_frame(spark, [(*pair, cycle, *found.values(), 0)], schema)


def new_errors(errors: DataFrame, known: DataFrame) -> DataFrame:
    """Errors that are not in the log yet: a row that stays bad is reported in its first cycle only.

    Several of one cycle that agree in everything else stay as many.
    """
    same = [*FLUX_KEY, "pk_value", "audit_error"]
    mine = errors.alias("_new")
    match = [F.col(f"_new.{c}").eqNullSafe(F.col(f"_known_{c}")) for c in same]
    before = known.select(*[F.col(c).alias(f"_known_{c}") for c in same])
    return mine.join(before, all_of(match), "left_anti").select(*errors.columns)


def upsert_flux(existing: DataFrame, delta: DataFrame) -> DataFrame:
    """Audit table after a cycle: the row of each job and table pair replaced or added."""
    return upsert(existing, delta, FLUX_KEY)


def error_log(
    rejected: DataFrame,
    job: SyncJob,
    spec: TableSpec,
    reason: Column | str,
    *,
    level: str = "ERROR",
    operator: str = "rowtide",
    log_time: datetime | None = None,
    side: str = "source",
) -> DataFrame:
    """Rejected rows in the layout of the error log. A row without a key has an empty one.

    The key comes from the key columns, or from ``pks`` where ``rejected`` are log rows.
    """
    key = F.col("pks") if "pks" in rejected.columns else encode_pks(spec.fields, side=side)
    when = F.current_timestamp() if log_time is None else F.lit(log_time)
    message = reason if isinstance(reason, Column) else F.lit(reason)
    return rejected.select(
        when.cast("timestamp_ntz").alias("log_time"),
        F.lit(level).alias("level"),
        *_pair(job, spec),
        F.coalesce(key, F.lit("")).alias("pk_value"),
        message.alias("audit_error"),
        F.lit(operator).alias("operator"),
        F.lit(0).alias("flag"),
    )
