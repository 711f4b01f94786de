"""What several operators share: input columns, ASCII folding, bounded Arrow batches."""

from __future__ import annotations

import string
import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows per Arrow batch: a few MB of ordinary documents, some tens of MB of very long ones.
BATCH_ROWS = 512
# Rows of two longs that are broadcast at most: about 60 MB.
BROADCAST_ROWS = 1 << 20


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small enough for long texts; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")


def whole(text: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z, and nothing else, in lower case.

    Texts of one byte per character go through Spark's faster ``lower``, which does
    the same to them.
    """
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def quoted(name: str) -> str:
    """A column's name as Spark reads it literally, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Arrow batches of a task put together until they hold ``size`` bytes."""
    held, held_bytes = [], 0
    for batch in batches:
        held.append(batch)
        held_bytes += batch.nbytes
        if held_bytes >= size:
            yield pa.Table.from_batches(held)
            held, held_bytes = [], 0
    if held:
        yield pa.Table.from_batches(held)


def per_process(key: tuple, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept for the later tasks of the same worker process.

    Functions come to the workers by value, and their modules' globals with them; only
    what is filed under ``sys.modules`` outlives a task.
    """
    kept = sys.modules.setdefault("_rowtide_kept", types.ModuleType("_rowtide_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def broadcast_small(settled: DataFrame, rows: int) -> DataFrame:
    """A written table, to be broadcast if it has no more than so many rows."""
    return F.broadcast(settled) if settled.count() <= rows else settled


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less the rows that ``gone`` (written already) names by ``_id`` and ``_raw``.

    ``_raw`` is :func:`raw_hash` of the text, so that rows which share an identifier are
    told apart. Up to ``BROADCAST_ROWS`` rows of two longs the list goes to the texts;
    beyond that Spark joins as it sees fit.
    """
    listed = gone.select(F.col("_id").alias("_gone_id"), F.col("_raw").alias("_gone_raw"))
    listed = broadcast_small(listed, BROADCAST_ROWS)
    mine = F.col(quoted(id_col)).cast("long").eqNullSafe(listed["_gone_id"])
    return docs.join(listed, mine & (raw_hash(text_col) == listed["_gone_raw"]), "left_anti")


def raw_hash(text_col: str) -> Column:
    return F.xxhash64(whole(F.col(quoted(text_col))))
