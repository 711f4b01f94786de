"""Bring cells to the Spark type their column is declared with."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtide.functions.geometry import geometry_from_text
from rowtide.functions.types import normalise_jdbc
from rowtide.plans.spec import FieldSpec

# JDBC types whose primitive readers give false or 0 for NULL.
LEGACY_ZERO = {
    "BIT": "false",
    "TINYINT": "0",
    "SMALLINT": "0",
    "INTEGER": "0",
    "BIGINT": "0",
    "FLOAT": "0",
    "REAL": "0",
    "DOUBLE": "0",
}

CHARACTER_LARGE = ("CLOB", "LONGVARCHAR")


def coerce_cell(
    cell: Column, have: T.DataType, field: FieldSpec, *, lenient: bool = True
) -> Column:
    """One cell as the declared type; with ``lenient`` a bad value becomes NULL."""
    jdbc = normalise_jdbc(field.jdbc_type)
    want = T.DataType.fromDDL(field.spark_type)
    if have == want:
        return cell
    if jdbc == "STRUCT":
        return geometry_from_text(cell) if isinstance(have, T.StringType) else cell
    if jdbc == "ARRAY":
        return cell
    return cell.try_cast(field.spark_type) if lenient else cell.cast(field.spark_type)


def coerce(
    df: DataFrame,
    fields: Sequence[FieldSpec],
    *,
    legacy_nulls: bool = False,
    on_error: str = "null",
    clob_null_to_empty: bool = False,
) -> DataFrame:
    """Cast every mapped column of ``df`` (by source name), keep only those columns.

    ``on_error``: ``"null"`` turns an unreadable value into NULL, ``"raise"``
    fails the query. ``legacy_nulls`` reads NULL numbers and booleans as 0 and
    false. ``clob_null_to_empty`` writes a NULL long text as an empty string.
    """
    if on_error not in ("null", "raise"):
        raise ValueError(f"on_error: {on_error}")
    cells = typed_cells(
        df,
        fields,
        legacy_nulls=legacy_nulls,
        lenient=on_error == "null",
        clob_null_to_empty=clob_null_to_empty,
    )
    return df.select(*cells)


def typed_cells(
    df: DataFrame,
    fields: Sequence[FieldSpec],
    *,
    legacy_nulls: bool = False,
    lenient: bool = True,
    clob_null_to_empty: bool = False,
) -> list[Column]:
    """The cells that :func:`coerce` selects, to be put beside other columns."""
    cells = []
    for f in fields:
        cell = coerce_cell(F.col(f.source), df.schema[f.source].dataType, f, lenient=lenient)
        jdbc = normalise_jdbc(f.jdbc_type)
        if legacy_nulls and jdbc in LEGACY_ZERO:
            cell = F.coalesce(cell, F.lit(LEGACY_ZERO[jdbc]).cast(f.spark_type))
        if clob_null_to_empty and jdbc in CHARACTER_LARGE:
            cell = F.coalesce(cell, F.lit(""))
        cells.append(cell.alias(f.source))
    return cells


def failing_fields(df: DataFrame, fields: Sequence[FieldSpec]) -> Column:
    """Names of the columns whose value in this row cannot be read, as an array."""
    checks = [
        F.when(
            F.col(f.source).isNotNull()
            & coerce_cell(F.col(f.source), df.schema[f.source].dataType, f).isNull(),
            F.lit(f.source),
        )
        for f in fields
    ]
    return F.array_compact(F.array(*checks))


def coerce_failures(df: DataFrame, fields: Sequence[FieldSpec]) -> DataFrame:
    """Rows holding a value that cannot be read, with the column names in ``bad_fields``."""
    return df.withColumn("bad_fields", failing_fields(df, fields)).where(F.size("bad_fields") > 0)


def readable(
    df: DataFrame, fields: Sequence[FieldSpec], *, clob_null_to_empty: bool = False
) -> tuple[DataFrame, DataFrame | None]:
    """Typed rows, and the rows turned away for an unreadable value (None if there can be none).

    The latter are typed too, with NULL for what could not be read, and say why
    in ``reason``.
    """
    typed = coerce(df, fields, clob_null_to_empty=clob_null_to_empty)
    doubtful = [
        f for f in fields if typed.schema[f.source].dataType != df.schema[f.source].dataType
    ]
    if not doubtful:
        return typed, None
    marked = df.withColumn("bad_fields", failing_fields(df, doubtful))
    whole = marked.where(F.size("bad_fields") == 0)
    good = coerce(whole, fields, clob_null_to_empty=clob_null_to_empty)
    reason = F.concat(F.lit("unreadable value: "), F.array_join("bad_fields", ", "))
    bad = marked.where(F.size("bad_fields") > 0)
    cells = [
        coerce_cell(F.col(f.source), df.schema[f.source].dataType, f).alias(f.source)
        for f in fields
    ]
    return good, bad.select(*cells, reason.alias("reason"))
