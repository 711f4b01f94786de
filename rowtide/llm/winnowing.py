"""Document fingerprints by winnowing.

Every k-gram of code points has a hash. Of each window of w hashes in a row the least is
chosen, the rightmost of equal ones; what is chosen, each once and with its position, is
the fingerprint. Two texts that share ``w + k - 1`` code points in a row choose at least
one hash in common inside them, and neither chooses more than it must: about 2/(w+1) of
its hashes. A text of fewer than w hashes has one window, one of fewer than k code points
one hash of the whole.

Fingerprints of neighbours in identifier order are compared in one pass: rows go to parts
of ascending identifiers, each part also gets the first row of the next one, and a task
reads its rows in order, two at a time.

Defined results: a null text is an empty one, whose fingerprint is empty; two empty
fingerprints have likeness 1, an empty and another 0; null identifiers come first, rows
of one identifier are in the order of a hash of their texts; a single row is its own next;
texts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtide.llm.common import bounded_batches, quoted, whole

# Texts that share K + WINDOW - 1 = 10 code points in a row share a hash.
K = 6
WINDOW = 5
# Parts of ascending identifiers for each shuffle partition.
PARTS_EACH = 6

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Polynomial rolling hash of every k-gram, by doubling; the order of hashes is mixed."""
    size, base = 1, _BASE
    block = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    have, have_size = None, 0  # hash of the lowest bits of k taken so far
    left = k
    while left:
        if left & 1:
            if have is None:
                have, have_size = block, size
            else:
                n = len(points) - have_size - size + 1
                factor = np.uint64(pow(_BASE, size, _MASK + 1))
                have = have[:n] * factor + block[have_size : have_size + n]
                have_size += size
        left >>= 1
        if left:
            n = len(points) - 2 * size + 1
            block = block[:n] * np.uint64(base) + block[size : size + n]
            size, base = 2 * size, base * base & _MASK
    have ^= have >> np.uint64(31)
    have *= np.uint64(0xBF58476D1CE4E5B9)
    return (have >> np.uint64(32)).astype(np.uint32)


def window_minima(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash of every window, the rightmost of equal ones, each once."""
    window = min(window, len(hashes))
    # least hash first, then greatest position
    key = hashes.astype(np.uint64) << np.uint64(32)
    key |= np.uint64(0xFFFFFFFF) - np.arange(len(hashes), dtype=np.uint64)
    reach = 1
    while 2 * reach <= window:
        key = np.minimum(key[: len(key) - reach], key[reach:])
        reach *= 2
    rest = window - reach
    if rest:
        key = np.minimum(key[: len(key) - rest], key[rest:])
    first = np.concatenate(([True], key[1:] != key[:-1]))
    return (np.uint64(0xFFFFFFFF) - (key[first] & np.uint64(0xFFFFFFFF))).astype(np.int64)


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The chosen hashes of a text (32 bits each) and their positions, ascending."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    hashes = gram_hashes(points, min(k, len(points)))
    at = window_minima(hashes, window)
    return hashes[at], at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared distinct hashes as a part of all distinct hashes."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def written(hashes: np.ndarray) -> str:
    """Eight hex digits for each hash, in order of position."""
    return hashes.astype(">u4").tobytes().hex()


def fingerprints(
    docs: DataFrame,
    k: int = K,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id hashes positions`` of every row."""
    bounded_batches(docs.sparkSession)

    def work(batches):
        for batch in batches:
            found = [winnow(t, k, window) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array((h.astype(np.int64) for h, _ in found), pa.list_(pa.int64())),
                    pa.array((at for _, at in found), pa.list_(pa.int64())),
                ],
                ["doc_id", "hashes", "positions"],
            )

    slim = docs.select(
        F.col(quoted(id_col)).alias("doc_id"), whole(F.col(quoted(text_col))).alias("_text")
    )
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(work, f"doc_id {kind}, hashes array<long>, positions array<long>")


def _part(value: Column, bounds: list[int]) -> Column:
    """How many bounds lie below a value: found among every n-th bound, then between two."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    lasts = F.array(*[F.lit(g[-1]) for g in groups[:-1]]) if groups[:-1] else F.array().cast("array<bigint>")
    passed = F.size(F.filter(lasts, lambda b: b < value))
    group = F.element_at(F.array(*[F.array(*map(F.lit, g)) for g in groups]), passed + 1)
    inside = F.size(F.filter(group, lambda b: b < value))
    return F.when(value.isNull(), 0).otherwise(passed * step + inside)


def _with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows dealt to parts of ascending identifiers, each part closed by the row after it."""
    spark = docs.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = whole(F.col(quoted(text_col)))
    base = docs.select(
        F.col(quoted(id_col)).cast("long").alias("_id"), F.xxhash64(text).alias("_h"), text.alias("_text")
    )
    parts = shuffle * PARTS_EACH
    cuts = [i / parts for i in range(1, parts)]
    # as many bounds as parts, whatever the rows
    bounds = base.agg(F.percentile_approx("_id", F.array(*map(F.lit, cuts)), 100 * parts)).first()[0]
    dealt = base.withColumn("_part", _part(F.col("_id"), sorted(set(bounds or []))))
    order = F.struct(F.col("_id").isNotNull().alias("n"), F.col("_id").alias("i"), F.col("_h").alias("h"))
    heads = dealt.groupBy("_part").agg(F.min(order).alias("f")).select("_part", "f.i", "f.h").collect()
    heads = sorted(heads, key=lambda r: r[0])
    if not heads:
        return dealt.withColumn("_end", F.lit(False))
    # the first row of a part also goes to the part before, the very first to the last
    before = {heads[i][0]: heads[i - 1][0] for i in range(len(heads))}
    firsts = F.create_map(*[F.lit(x) for h in heads for x in (h[0], h[2])])
    ids = F.create_map(*[x for h in heads for x in (F.lit(h[0]), F.lit(h[1]).cast("long"))])
    to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    part = F.col("_part")
    is_first = F.col("_id").eqNullSafe(F.element_at(ids, part)) & (F.col("_h") == F.element_at(firsts, part))
    stay = F.struct(part.alias("_part"), F.lit(False).alias("_end"))
    close = F.struct(F.element_at(to, part).alias("_part"), F.lit(True).alias("_end"))
    where = F.explode(F.when(is_first, F.array(stay, close)).otherwise(F.array(stay)))
    return (
        dealt.select("_id", "_h", "_text", where.alias("w"))
        .select("_id", "_h", "_text", "w._part", "w._end")
        .repartition(shuffle, "_part")
        .sortWithinPartitions("_part", "_end", F.col("_id").asc_nulls_first(), "_h")
    )


def edited_fingerprints(
    docs: DataFrame,
    k: int = K,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Each text, and an edit of it, against its neighbour's fingerprint.

    In the edited text the last half of the code points is replaced by the first as many
    (or all) of the next document in identifier order; after the last comes the first.
    """
    bounded_batches(docs.sparkSession)
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    names = T.StructType.fromDDL(schema).names

    def work(batches):
        held = None  # a row that waits for the next: part, id, text, hashes
        for batch in batches:
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("_part", "_end", "_id", "_text")]
            for part, end, ident, text in zip(*columns, strict=True):
                if held is not None and held[0] == part:
                    hashes = winnow(text, k, window)[0]
                    rows.append(_compared(held, text, hashes, k, window))
                elif not end:
                    hashes = winnow(text, k, window)[0]
                held = None if end else (part, ident, text, hashes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)] if rows else [pa.array([], t) for t in _KINDS],
                names,
            )

    return _with_next(docs, id_col, text_col).select("_part", "_end", "_id", "_text").mapInArrow(work, schema)


_KINDS = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]


def _compared(held, following: str, following_hashes: np.ndarray, k: int, window: int) -> tuple:
    _, ident, text, hashes = held
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    edited_hashes = winnow(edited, k, window)[0]
    return (
        ident,
        len(text),
        hashlib.sha256(edited.encode()).hexdigest(),
        written(hashes),
        written(edited_hashes),
        likeness(hashes, edited_hashes),
        likeness(hashes, following_hashes),
    )
