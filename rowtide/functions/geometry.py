"""Geometry values as text and as structs.

The text form, fixed by the systems that exchange it, is
``{g:2001,s:8307,x:'1.5',y:'2.5',z:'NaN',e:'1|1003|1',o:'1.0|2.0'}``; a missing
array is written ``'null'``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# How lax the text may be, and its members; all are read as text first.
_LAX = {"allowUnquotedFieldNames": "true", "allowSingleQuotes": "true", "allowNonNumericNumbers": "true"}
_MEMBERS = "g string, s string, x string, y string, z string, e string, o string"


def _joined(array: Column) -> Column:
    text = F.array_join(array.cast("array<string>"), "|")
    return F.when(F.size(array) > 0, text).otherwise(F.lit("null"))


def _number(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("NaN"))


def geometry_to_text(geometry: Column) -> Column:
    """Struct ``(g, s, x, y, z, e, o)`` to text; NULL stays NULL."""
    part = geometry.getField
    text = F.format_string(
        "{g:%d,s:%d,x:'%s',y:'%s',z:'%s',e:'%s',o:'%s'}",
        part("g"),
        part("s"),
        _number(part("x")),
        _number(part("y")),
        _number(part("z")),
        _joined(part("e")),
        _joined(part("o")),
    )
    return F.when(geometry.isNotNull(), text)


def split_numbers(text: Column, element: str) -> Column:
    """``1|1003|1`` to an array of ``element``; the word null, and no text, give NULL."""
    bare = F.lower(F.trim(F.regexp_replace(text, '"', "")))
    return F.when(~bare.isin("null", ""), F.split(text, r"\|").try_cast(f"array<{element}>"))


def geometry_from_text(text: Column) -> Column:
    """Text to struct ``(g, s, x, y, z, e, o)``; unreadable text gives NULL."""

    def shape(parsed: Column) -> Column:
        part = parsed.getField
        value = F.struct(
            *[part(name).try_cast("int").alias(name) for name in ("g", "s")],
            *[part(name).try_cast("double").alias(name) for name in ("x", "y", "z")],
            split_numbers(part("e"), "int").alias("e"),
            split_numbers(part("o"), "double").alias("o"),
        )
        return F.when(part("g").try_cast("int").isNotNull(), value)

    # as the one element of an array the text is parsed once, not once for each member
    return F.get(F.transform(F.array(F.from_json(text, _MEMBERS, _LAX)), shape), F.lit(0))
