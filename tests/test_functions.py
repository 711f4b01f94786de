from __future__ import annotations

import datetime as dt
import math

import pytest
from helpers import as_set
from pyspark.sql import functions as F

from rowtide import FieldSpec
from rowtide.functions.coerce import coerce, coerce_failures, readable
from rowtide.functions.geometry import geometry_from_text, geometry_to_text
from rowtide.functions.keys import cast_key, encode_pks, key_columns, parse_pks
from rowtide.functions.types import type_catalog
from rowtide.session import prepare

TEXT = "{g:2001,s:8307,x:'1.5',y:'2.5',z:'NaN',e:'1|1003|1',o:'1.0|2.0'}"
BARE = "{g:2001,s:8307,x:'1.5',y:'2.5',z:'NaN',e:'null',o:'null'}"
JSON = '{"g": 2001, "s": 8307, "x": "1.5", "y": "2.5", "z": "NaN", "e": "null", "o": "1.0|2.0"}'


def test_geometry_round_trip(spark):
    df = spark.createDataFrame([(TEXT,), (BARE,), ("nonsense",), (None,)], "t string")
    got = df.select("t", geometry_from_text(F.col("t")).alias("p"))
    rows = {r["t"]: r["p"] for r in got.collect()}
    assert rows[TEXT]["e"] == [1, 1003, 1] and rows[TEXT]["o"] == [1.0, 2.0]
    assert math.isnan(rows[TEXT]["z"]) and rows[TEXT]["g"] == 2001
    assert rows[BARE]["e"] is None and rows[BARE]["o"] is None
    assert rows["nonsense"] is None and rows[None] is None
    back = got.select(geometry_to_text(F.col("p")).alias("t"))
    assert as_set(back) == sorted([(TEXT,), (BARE,), (None,), (None,)], key=repr)


def test_geometry_reads_quoted_names(spark):
    p = spark.createDataFrame([(JSON,)], "t string").select(geometry_from_text(F.col("t"))).first()[0]
    assert (p["g"], p["x"], p["e"], p["o"]) == (2001, 1.5, None, [1.0, 2.0])


def test_vendor_types(spark):
    df = spark.createDataFrame(
        [
            ("oracle", " VARCHAR2(30) "),
            ("oracle", "TIMESTAMP(6)"),
            ("Oracle", "SDO_GEOMETRY"),
            ("mssql", "bigint identity"),
            ("mssql", "timestamp"),
            ("mssql", "tinyint"),
            ("sybase", "double precis"),
            ("mysql", "LONGTEXT"),
            ("db2", "long varchar"),
            ("db2", "int identity"),
            ("oracle", "NUMBER(10,2)"),
            ("oracle", "NUMBER(5,9)"),
            ("nobody", "int"),
        ],
        "vendor string, type string",
    )
    got = {(r["vendor"], r["type"]): (r["jdbc_type"], r["spark_type"]) for r in type_catalog(df).collect()}
    assert got["oracle", " VARCHAR2(30) "] == ("VARCHAR", "string")
    assert got["oracle", "TIMESTAMP(6)"] == ("TIMESTAMP", "timestamp_ntz")
    assert got["Oracle", "SDO_GEOMETRY"][0] == "STRUCT"
    assert got["mssql", "bigint identity"] == ("BIGINT", "bigint")
    assert got["mssql", "timestamp"] == ("BINARY", "binary")
    assert got["mssql", "tinyint"] == ("TINYINT", "smallint")
    assert got["sybase", "double precis"] == ("DOUBLE", "double")
    assert got["mysql", "LONGTEXT"] == ("CLOB", "string")
    assert got["db2", "long varchar"] == ("LONGVARCHAR", "string")
    assert got["db2", "int identity"] == ("VARCHAR", "string")
    assert got["oracle", "NUMBER(10,2)"] == ("NUMERIC", "decimal(10,2)")
    assert got["oracle", "NUMBER(5,9)"] == ("NUMERIC", "decimal(38,10)")
    assert got["nobody", "int"] == ("VARCHAR", "string")


ALL = [
    FieldSpec("b", "b", jdbc_type="BIT"),
    FieldSpec("t", "t", jdbc_type="TINYINT"),
    FieldSpec("s", "s", jdbc_type="SMALLINT"),
    FieldSpec("i", "i", jdbc_type="INTEGER"),
    FieldSpec("r", "r", jdbc_type="REAL"),
    FieldSpec("f", "f", jdbc_type="FLOAT"),
    FieldSpec("n", "n", jdbc_type="NUMERIC"),
    FieldSpec("d", "d", jdbc_type="DATE"),
    FieldSpec("c", "c", jdbc_type="CLOB"),
    FieldSpec("v", "v", jdbc_type="BLOB"),
    FieldSpec("g", "g", jdbc_type="STRUCT"),
]


def test_coerce_every_type(spark):
    names = [f.source for f in ALL]
    good = ("true", "7", "300", "70000", "1.5", "2.5", "3.25", "2024-01-02 03:04:05", "long", "bytes", TEXT)
    bad = ("maybe", "300", "70000", "x", "y", "z", "1,2", "then", None, None, "oops")
    none = (None,) * len(names)
    df = spark.createDataFrame([good, bad, none], ", ".join(f"{n} string" for n in names))
    first, second, third = coerce(df, ALL).collect()
    assert first[:6] == (True, 7, 300, 70000, 1.5, 2.5)
    assert str(first["n"]) == "3.2500000000"
    assert first["d"] == dt.datetime(2024, 1, 2, 3, 4, 5) and bytes(first["v"]) == b"bytes"
    assert first["g"]["g"] == 2001
    assert tuple(second) == none and tuple(third) == none
    zero = coerce(df, ALL, legacy_nulls=True, clob_null_to_empty=True).collect()[2]
    assert zero[:6] == (False, 0, 0, 0, 0.0, 0.0) and zero["n"] is None and zero["c"] == ""
    failures = coerce_failures(df, ALL).collect()
    assert len(failures) == 1
    assert failures[0]["bad_fields"] == ["b", "t", "s", "i", "r", "f", "n", "d", "g"]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        coerce(df, ALL[:4], on_error="raise").collect()


def test_readable_splits_rows(spark):
    df = spark.createDataFrame([("1", "a"), ("x", "b"), (None, "c")], "i string, c string")
    fields = [FieldSpec("i", "i", jdbc_type="INTEGER"), FieldSpec("c", "c")]
    good, bad = readable(df, fields)
    assert as_set(good) == sorted([(1, "a"), (None, "c")], key=repr)
    assert as_set(bad) == [(None, "b", "unreadable value: i")]
    assert readable(df, [FieldSpec("c", "c")])[1] is None


def test_time_columns(spark):
    spark.conf.set("spark.sql.timeType.enabled", "true")
    df = spark.createDataFrame([("10:11:12",)], "t string")
    got = coerce(df, [FieldSpec("t", "t", jdbc_type="TIME")]).first()[0]
    assert got == dt.time(10, 11, 12)


KEYS = [
    FieldSpec("id", "k1", True, "BIGINT", "NUMBER"),
    FieldSpec("name", "k2", True, "VARCHAR", "VARCHAR2"),
    FieldSpec("at", "k3", True, "TIMESTAMP", "TIMESTAMP"),
    FieldSpec("x", "x", False, "VARCHAR"),
]


def test_key_text_with_separators(spark):
    rows = [
        (1, "a,b;c%2C%", dt.datetime(2024, 1, 2, 3, 4, 5, 678901)),
        (2, "", dt.datetime(1999, 12, 31)),
        (-3, "plain", dt.datetime(2024, 2, 29, 23, 59, 59)),
    ]
    df = spark.createDataFrame(rows, "id bigint, name string, at timestamp_ntz")
    text = df.select(encode_pks(KEYS).alias("pks"))
    assert "id,name,at;NUMBER,VARCHAR2,TIMESTAMP;-3,plain,2024-02-29 23:59:59.000000;" in [
        r[0] for r in text.collect()
    ]
    assert as_set(key_columns(text, KEYS)) == sorted(rows, key=repr)


def test_null_and_broken_keys(spark):
    df = spark.createDataFrame([(1, None)], "id bigint, name string").withColumn(
        "at", F.lit("2024-01-01").cast("timestamp_ntz")
    )
    assert df.select(encode_pks(KEYS)).first()[0] is None
    broken = ["", "id;NUMBER", "id;NUMBER;x;", "other;NUMBER;1;", "ID,Name,AT;a,b,c;5,n,2024-01-01;", None]
    text = spark.createDataFrame([(b,) for b in broken], "pks string")
    got = key_columns(text.withColumn("was", F.col("pks")), KEYS[:1]).collect()
    assert {r["was"]: r["id"] for r in got} == dict.fromkeys(broken) | {broken[4]: 5}


def test_parse_and_cast(spark):
    df = spark.createDataFrame([("id1,id2;number,varchar2;2,bcd;",)], "pks string")
    p = df.select(parse_pks(F.col("pks"))).first()[0]
    assert (p["names"], p["types"], p["values"]) == (["id1", "id2"], ["number", "varchar2"], ["2", "bcd"])
    one = spark.range(1)
    pick = lambda text, kind: one.select(cast_key(F.lit(text), kind)).first()[0]
    assert float(pick("2.5", "NUMERIC")) == 2.5
    assert pick("2024-01-01 00:00:01", "DATE") == dt.datetime(2024, 1, 1, 0, 0, 1)
    assert pick("no", "INTEGER") is None


def test_time_keys_survive_the_trip(spark):
    prepare(spark)
    fields = (FieldSpec("t", "t", pk=True, jdbc_type="TIME"), FieldSpec("n", "n", pk=True, jdbc_type="BIGINT"))
    df = spark.sql("SELECT TIME'12:34:56.25' AS t, 7L AS n UNION ALL SELECT TIME'00:00:00', 8L")
    back = key_columns(df.select(encode_pks(fields).alias("pks")), fields)
    assert back.schema["t"].dataType.simpleString() == "time(6)"
    assert as_set(back.select(F.col("t").cast("string"), "n")) == as_set(df.select(F.col("t").cast("string"), "n"))
    bad = spark.createDataFrame([("t,n;TIME,NUMBER;noon,1;",)], "pks string")
    assert key_columns(bad, fields).first()["t"] is None
