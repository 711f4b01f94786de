"""Key text of the change log: ``names;types;values;``, each comma separated.

A comma, semicolon or percent sign inside a value is written as ``%2C``,
``%3B`` or ``%25``, so any key value survives the trip.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtide.functions.types import normalise_jdbc
from rowtide.plans.spec import FieldSpec

# Text formats of date and timestamp keys.
DATE_TEXT = "yyyy-MM-dd HH:mm:ss"
TIMESTAMP_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"

# What stands for a separator inside a key value.
ESCAPES = [("%", "%25"), (",", "%2C"), (";", "%3B")]


def _escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def _unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def key_text(value: Column, jdbc_type: str) -> Column:
    """One key value as text."""
    jdbc = normalise_jdbc(jdbc_type)
    if jdbc == "DATE":
        return F.date_format(value, DATE_TEXT)
    if jdbc == "TIMESTAMP":
        return F.date_format(value, TIMESTAMP_TEXT)
    return value.cast("string")


def cast_key(text: Column, jdbc_type: str) -> Column:
    """Key text as a typed value; unreadable text gives NULL."""
    jdbc = normalise_jdbc(jdbc_type)
    if jdbc in ("DATE", "TIMESTAMP"):
        return text.try_cast("timestamp_ntz")
    return text.try_cast(FieldSpec("", "", jdbc_type=jdbc).spark_type)


def encode_pks(fields: Sequence[FieldSpec], *, side: str = "source") -> Column:
    """Key columns as one text, named as on ``side`` and read by those names."""
    keys = [f for f in fields if f.pk]
    names = ",".join(getattr(f, side) for f in keys)
    types = ",".join(f.db_type or f.jdbc_type for f in keys)
    values = [_escape(key_text(F.col(getattr(f, side)), f.jdbc_type)) for f in keys]
    # concat (unlike concat_ws) gives NULL for a NULL key instead of a shorter text
    joined = values[0]
    for value in values[1:]:
        joined = F.concat(joined, F.lit(","), value)
    return F.concat(F.lit(f"{names};{types};"), joined, F.lit(";"))


def parse_pks(pks: Column) -> Column:
    """Key text as ``struct<names, types, values>``, three string arrays."""
    parts = F.split(pks, ";")
    pick = lambda n: F.split(F.get(parts, F.lit(n)), ",")
    return F.struct(
        pick(0).alias("names"),
        pick(1).alias("types"),
        F.transform(pick(2), _unescape).alias("values"),
    )


def comparable_pks(
    pks: Column, fields: Sequence[FieldSpec] | None = None, *, side: str = "source"
) -> Column:
    """Key text that is equal for equal keys, whatever type names it carries.

    With the ``fields`` of the table the key columns are compared by typed values, in the
    order of the spec; a key that cannot be read, or any key without the fields, by its
    names (without regard to case) and its values' texts as they are written.
    """
    # types are left out, and no arrays are taken apart unless there are several columns
    names = F.upper(F.trim(F.substring_index(pks, ";", 1)))
    values = F.substring_index(F.substring_index(pks, ";", 3), ";", -1)
    whole = F.substring_index(pks, ";", 2) != pks
    plain = F.when(whole, F.concat(names, F.lit("="), values)).otherwise(pks)
    keys = [f for f in fields or () if f.pk]
    if not keys:
        return plain
    if len(keys) == 1:
        name = getattr(keys[0], side).upper()
        mine = F.when(whole & (names == F.lit(name)), cast_key(_unescaped(values), keys[0].jdbc_type))
        text = _escaped(key_text(mine.cast(keys[0].spark_type), keys[0].jdbc_type))
        return F.coalesce(F.concat(F.lit(f"{name}="), text), plain)
    # a value typed and written again is the same text for 1, 01 and 1.0 of a whole number
    split_names = F.transform(F.split(names, ","), lambda n: F.trim(n))
    typed = [
        F.concat(
            F.lit(getattr(f, side).upper() + "="),
            _escaped(key_text(_typed_key(split_names, values, f, side), f.jdbc_type)),
        )
        for f in keys
    ]
    text = typed[0]
    for one in typed[1:]:
        text = F.concat(text, F.lit(","), one)
    return F.coalesce(text, plain)


def _typed_key(names: Column, values: Column, field: FieldSpec, side: str) -> Column:
    place = F.array_position(names, F.lit(getattr(field, side).upper()))
    value = F.when(place > 0, F.get(F.split(values, ","), (place - 1).cast("int")))
    return cast_key(_unescaped(value), field.jdbc_type).cast(field.spark_type)


def _unescaped(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("%")), _unescape(text)).otherwise(text)


def _escaped(text: Column) -> Column:
    """Escaped only where there is something to escape."""
    odd = F.contains(text, F.lit("%")) | F.contains(text, F.lit(",")) | F.contains(text, F.lit(";"))
    return F.when(odd, _escape(text)).otherwise(text)


def key_columns(
    log: DataFrame,
    fields: Sequence[FieldSpec],
    *,
    side: str = "source",
    out: Sequence[str] | None = None,
) -> DataFrame:
    """Replace ``pks`` of one table's log by typed key columns.

    The text names them as on ``side``, without regard to case; the columns are
    called the same, or as ``out`` says. A key that is missing or unreadable
    becomes NULL.
    """
    parsed = log.withColumn("_pks", parse_pks(F.col("pks")))
    names = F.transform("_pks.names", lambda n: F.upper(F.trim(n)))
    keys = [f for f in fields if f.pk]
    for f, column in zip(keys, out or [getattr(f, side) for f in keys], strict=True):
        name = getattr(f, side)
        place = F.array_position(names, F.lit(name.upper()))
        value = F.when(place > 0, F.get(F.col("_pks.values"), (place - 1).cast("int")))
        typed = cast_key(value, f.jdbc_type)
        parsed = parsed.withColumn(column, typed.cast(f.spark_type))
    return parsed.drop("_pks", "pks")
