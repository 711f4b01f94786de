"""A uniform shuffle of all rows into shards of exact size.

The rows lie in parts. How many rows of each part go to each shard is drawn first, as an
exact multivariate hypergeometric variate: the *communication matrix*. Its row sums are
the sizes of the parts and its column sums the sizes of the shards, so shard sizes are at
most one apart whatever is drawn. Each part then permutes its rows and gives the first so
many to shard 0, the next to shard 1 and so on; rows are exchanged, and each shard
permutes what it received. Every arrangement of rows in shards is equally likely.

Rows are looked at as slim rows (identifier, size, checksum); the permutations are orders
by a seeded hash, so that a lost task gives the same rows again. Slots inside a shard are
numbered by spans of that hash, many tasks to a shard. The matrix has a bounded number of
parts (``PARTS``), however many rows there are.

Defined results: a null text has size 1 and checksum 0; rows with equal or null
identifiers are rows of their own; equal texts are not held together, which exact equal
shard sizes rule out; an empty table gives no rows.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowtide.llm.common import quoted, whole
from rowtide.session import empty_frame, settle

SHARDS = 8
SEED = 20240501
# Parts of the communication matrix at most, and spans in which a shard's slots are numbered.
PARTS = 8192
SPANS = 1024
# Cells of the matrix, of 8 bytes, up to which it is broadcast.
BROADCAST_CELLS = 1 << 18


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """An exact draw of how many of ``drawn`` rows are ``good``; sizes are not limited.

    Inversion from the mode: probabilities next to each other have a simple ratio, and
    what lies 12 standard deviations away is below the resolution of a double.
    """
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))
    spread = (drawn * (good / total) * (bad / total) * ((total - drawn) / max(1, total - 1))) ** 0.5
    reach = int(12 * spread) + 30
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=float)  # from k to k + 1
    ratio = (good - k) * (drawn - k) / ((k + 1) * (bad - drawn + k + 1))
    at = mode - low
    up = np.cumprod(ratio[at:])
    down = np.cumprod(1 / ratio[:at][::-1])[::-1]
    weight = np.concatenate([down, [1.0], up])
    return low + int(np.searchsorted(np.cumsum(weight), rng.random() * weight.sum(), "right"))


def communication_matrix(sizes: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows sent from each part to each shard."""
    rng = np.random.default_rng(seed)
    total = sum(sizes)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for size in sizes:
        free, row, left = sum(room), [], size
        for s in range(shards):
            got = hypergeometric(rng, room[s], free - room[s], left)
            row.append(got)
            free -= room[s]
            left -= got
            room[s] -= got
        matrix.append(row)
    return matrix


def shuffle_into_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id size text_crc32 shard slot`` of every row."""
    spark = docs.sparkSession
    text = F.col(quoted(text_col))
    slim = settle(
        docs.select(
            F.col(quoted(id_col)).alias("_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("_size"),
            F.crc32(whole(text).cast("binary")).alias("_crc"),
            F.monotonically_increasing_id().alias("_uid"),
        ).select("*", (F.shiftrightunsigned("_uid", 33) % PARTS).cast("int").alias("_part"))
    )
    # at most PARTS rows
    sizes = {r[0]: r[1] for r in slim.groupBy("_part").count().collect()}
    if not sizes:
        return empty_frame(spark, "doc_id long, size long, text_crc32 long, shard int, slot long")
    parts = sorted(sizes)
    matrix = communication_matrix([sizes[p] for p in parts], shards, seed)
    local = Window.partitionBy("_part").orderBy(F.xxhash64("_uid", F.lit(seed)), "_uid")
    sent = settle(
        slim.withColumn("_at", F.row_number().over(local))
        .join(_plan(spark, parts, matrix), "_part")
        .select(
            "_id",
            "_size",
            "_crc",
            "_uid",
            F.size(F.filter("_ends", lambda e: e < F.col("_at"))).alias("_shard"),
            F.xxhash64("_uid", F.lit(seed + 1)).alias("_order"),
        )
        .withColumn("_span", F.pmod(F.shiftrightunsigned("_order", 20), F.lit(SPANS)).cast("int"))
    )
    # shards x SPANS rows, numbered shard by shard
    before = Window.partitionBy("_shard").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sent.groupBy("_shard", "_span")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_shard", "_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("_shard", "_span").orderBy("_order", "_uid")
    return (
        sent.withColumn("_at", F.row_number().over(inside))
        .join(starts, ["_shard", "_span"])
        .select(
            F.col("_id").alias("doc_id"),
            F.col("_size").alias("size"),
            F.col("_crc").alias("text_crc32"),
            F.col("_shard").cast("int").alias("shard"),
            (F.col("_start") + F.col("_at") - 1).cast("long").alias("slot"),
        )
    )


def _plan(spark: SparkSession, parts: list[int], matrix: list[list[int]]) -> DataFrame:
    """The matrix as rows: a part, and where each shard's rows end in its permutation."""
    rows = [
        {"_part": p, "_ends": np.cumsum(row).tolist()} for p, row in zip(parts, matrix, strict=True)
    ]
    kind = "array<struct<_part: int, _ends: array<bigint>>>"
    frame = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))
    return F.broadcast(frame) if len(parts) * len(matrix[0]) <= BROADCAST_CELLS else frame
