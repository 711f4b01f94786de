"""Vendor column types, JDBC types and the Spark types they become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.session import small_frame

# JDBC type name -> (java.sql.Types code, Spark type).
JDBC_TYPES: dict[str, tuple[int, str]] = {
    "ARRAY": (2003, "array<string>"),
    "BIGINT": (-5, "bigint"),
    "BINARY": (-2, "binary"),
    "BIT": (-7, "boolean"),
    "BLOB": (2004, "binary"),
    "CHAR": (1, "string"),
    "CLOB": (2005, "string"),
    "DATE": (91, "timestamp_ntz"),
    "DECIMAL": (3, "decimal(38,10)"),
    "DISTINCT": (2001, ""),
    "DOUBLE": (8, "double"),
    "FLOAT": (6, "float"),
    "INTEGER": (4, "int"),
    "JAVA_OBJECT": (2000, ""),
    "LONGVARBINARY": (-4, "binary"),
    "LONGVARCHAR": (-1, "string"),
    "NULL": (0, ""),
    "NUMERIC": (2, "decimal(38,10)"),
    "OTHER": (1111, ""),
    "REAL": (7, "float"),
    "REF": (2006, ""),
    "SMALLINT": (5, "smallint"),
    "STRUCT": (
        2002,
        "struct<g:int,s:int,x:double,y:double,z:double,e:array<int>,o:array<double>>",
    ),
    "TIME": (92, "time(6)"),
    "TIMESTAMP": (93, "timestamp_ntz"),
    "TINYINT": (-6, "tinyint"),
    "VARBINARY": (-3, "binary"),
    "VARCHAR": (12, "string"),
}

# Vendor type name -> JDBC type name. A name that is not listed
# is taken as VARCHAR. "x identity" in SQL Server and Sybase means x.
VENDOR_TYPES: dict[str, dict[str, str]] = {
    "oracle": {
        "char": "CHAR",
        "varchar2": "VARCHAR",
        "long": "LONGVARCHAR",
        "number": "NUMERIC",
        "raw": "VARBINARY",
        "longraw": "LONGVARBINARY",
        "date": "DATE",
        "time": "TIME",
        "timestamp": "TIMESTAMP",
        "blob": "BLOB",
        "clob": "CLOB",
        "sdo_geometry": "STRUCT",
    },
    "mssql": {
        "bigint": "BIGINT",
        "binary": "BINARY",
        "bit": "BIT",
        "char": "CHAR",
        "datetime": "TIMESTAMP",
        "decimal": "DECIMAL",
        "float": "DOUBLE",
        "image": "BLOB",
        "int": "INTEGER",
        "money": "DECIMAL",
        "nchar": "CHAR",
        "ntext": "LONGVARCHAR",
        "numeric": "NUMERIC",
        "nvarchar": "VARCHAR",
        "real": "REAL",
        "smalldatetime": "TIMESTAMP",
        "smallint": "SMALLINT",
        "smallmoney": "DECIMAL",
        "sql_variant": "VARCHAR",
        "sysname": "VARCHAR",
        "text": "CLOB",
        "timestamp": "BINARY",
        "tinyint": "TINYINT",
        "uniqueidentifier": "CHAR",
        "varbinary": "VARBINARY",
        "varchar": "VARCHAR",
    },
    "mysql": {
        "bigint": "BIGINT",
        "binary": "BINARY",
        "bit": "BIT",
        "blob": "BLOB",
        "char": "CHAR",
        "date": "DATE",
        "datetime": "TIMESTAMP",
        "decimal": "DECIMAL",
        "double": "DOUBLE",
        "float": "FLOAT",
        "int": "INTEGER",
        "longblob": "BLOB",
        "longtext": "CLOB",
        "mediumblob": "BLOB",
        "mediumint": "INTEGER",
        "mediumtext": "CLOB",
        "numeric": "NUMERIC",
        "smallint": "SMALLINT",
        "text": "CLOB",
        "time": "TIME",
        "timestamp": "TIMESTAMP",
        "tinyint": "TINYINT",
        "varbinary": "VARBINARY",
        "varchar": "VARCHAR",
    },
    "db2": {
        "bigint": "BIGINT",
        "blob": "BLOB",
        "character": "CHAR",
        "clob": "CLOB",
        "date": "DATE",
        "dbclob": "CLOB",
        "decimal": "DECIMAL",
        "double": "DOUBLE",
        "float": "DOUBLE",
        "graphics": "VARCHAR",
        "integer": "INTEGER",
        "long varchar": "LONGVARCHAR",
        "long vargraphics": "LONGVARCHAR",
        "number": "NUMERIC",
        "smallint": "SMALLINT",
        "time": "TIME",
        "timestamp": "TIMESTAMP",
        "varchar": "VARCHAR",
        "vargraphics": "LONGVARCHAR",
    },
    "sybase": {
        "bigint": "BIGINT",
        "binary": "BINARY",
        "bit": "BIT",
        "char": "CHAR",
        "date": "DATE",
        "datetime": "TIMESTAMP",
        "decimal": "DECIMAL",
        "double precis": "DOUBLE",
        "float": "DOUBLE",
        "image": "BLOB",
        "int": "INTEGER",
        "money": "DECIMAL",
        "nchar": "CHAR",
        "ntext": "LONGVARCHAR",
        "numeric": "NUMERIC",
        "nvarchar": "VARCHAR",
        "real": "REAL",
        "smalldatetime": "TIMESTAMP",
        "smallint": "SMALLINT",
        "smallmoney": "DECIMAL",
        "sql_variant": "VARCHAR",
        "sysname": "VARCHAR",
        "text": "CLOB",
        "tinyint": "TINYINT",
        "uniqueidentifier": "CHAR",
        "varbinary": "VARBINARY",
        "varchar": "VARCHAR",
    },
}

# JDBC types that no column of a job may have.
UNSUPPORTED = ("NULL", "DISTINCT", "JAVA_OBJECT", "OTHER", "REF")

# Vendors whose one-byte integer has no sign, so that it needs a wider type.
UNSIGNED_TINYINT = ("mssql", "sybase")


def normalise_jdbc(name: str) -> str:
    """JDBC type name in upper case; an unknown one is VARCHAR."""
    name = (name or "").strip().upper()
    return name if name in JDBC_TYPES else "VARCHAR"


def spark_type(jdbc_type: str, size: str = "") -> str:
    """Spark type of a JDBC type; ``size`` as ``"p"`` or ``"p,s"`` sizes a decimal."""
    name = normalise_jdbc(jdbc_type)
    if name in ("DECIMAL", "NUMERIC") and "," in size:
        precision, scale = (int(part) for part in size.split(",", 1))
        if 0 < precision <= 38 and 0 <= scale <= precision:
            return f"decimal({precision},{scale})"
    return JDBC_TYPES[name][1]


def vendor_type_map(spark: SparkSession) -> DataFrame:
    """The fixed vendor map as a DataFrame (some hundred rows)."""
    rows = [
        (
            vendor,
            name,
            jdbc,
            JDBC_TYPES[jdbc][0],
            "smallint"
            if jdbc == "TINYINT" and vendor in UNSIGNED_TINYINT
            else JDBC_TYPES[jdbc][1],
        )
        for vendor, names in VENDOR_TYPES.items()
        for name, jdbc in names.items()
    ]
    return small_frame(
        spark,
        rows,
        "vendor string, base_type string, jdbc_type string, jdbc_code int, spark_type string",
    )


def base_type(vendor: Column, type_text: Column) -> Column:
    """Type name without arguments: ``VARCHAR2(30)`` gives ``varchar2``."""
    name = F.lower(F.trim(F.regexp_replace(type_text, r"\(.*", "")))
    plain = F.trim(F.regexp_replace(name, r" identity$", ""))
    return F.when(F.lower(vendor).isin(*UNSIGNED_TINYINT), plain).otherwise(name)


def type_catalog(columns: DataFrame, vendor: str = "vendor", type_text: str = "type") -> DataFrame:
    """Add ``jdbc_type``, ``jdbc_code`` and ``spark_type`` to a catalog of columns.

    The vendor map is a fixed list, so it is always broadcast.
    """
    known = vendor_type_map(columns.sparkSession).withColumnsRenamed(
        {"vendor": "_vendor", "spark_type": "_spark_type", "jdbc_type": "_jdbc", "jdbc_code": "_code"}
    )
    vendor_name = F.lower(F.trim(F.col(vendor)))
    args = F.regexp_extract(F.col(type_text), r"\(\s*([0-9]+)\s*(?:,\s*([0-9]+)\s*)?\)", 1)
    scale = F.regexp_extract(F.col(type_text), r"\(\s*([0-9]+)\s*(?:,\s*([0-9]+)\s*)?\)", 2)
    scale = F.when(scale == "", "0").otherwise(scale)
    sized = (
        F.col("_jdbc").isin("DECIMAL", "NUMERIC")
        & args.try_cast("int").between(1, 38)
        & (scale.try_cast("int") <= args.try_cast("int"))
    )
    joined = columns.join(
        F.broadcast(known),
        (vendor_name == F.col("_vendor"))
        & (base_type(F.col(vendor), F.col(type_text)) == F.col("base_type")),
        "left",
    )
    return joined.select(
        *columns.columns,
        F.coalesce("_jdbc", F.lit("VARCHAR")).alias("jdbc_type"),
        F.coalesce("_code", F.lit(JDBC_TYPES["VARCHAR"][0])).alias("jdbc_code"),
        F.when(sized, F.concat(F.lit("decimal("), args, F.lit(","), scale, F.lit(")")))
        .otherwise(F.coalesce("_spark_type", F.lit("string")))
        .alias("spark_type"),
    )
