"""SimHash near-duplicates: exact components of fingerprints that differ in few bits.

A fingerprint bit is 1 if set in over half of the text's shingle hashes. Equal
fingerprints are first reduced to one. The distinct ones are dealt out to shards that
hold a ball of the Hamming space each: all fingerprints at distance 0 from a value of some
of their blocks. Of b blocks, r differing bits leave b - r equal, so two fingerprints
within r bits meet in at least one shard. A shard that is larger than ``HOT`` is divided
again in the same way by other blocks. Inside a shard a vantage-point tree finds the exact
pairs, pruned through triangle bounds; queries near a boundary go down both branches.

A shard emits links that span what it found, fewer than it has members, never all pairs.
Links of all shards are joined to components by contraction, in distributed rounds.

Defined results: a null or empty text has fingerprint zero and links like any other; null
identifiers never name a component (a component of nothing else has a null name); rows
with equal identifiers are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.llm.common import bounded_batches, gathered, quoted, raw_hash, whole, without
from rowtide.llm.components import components
from rowtide.llm.vptree import LEAF, join_labels, join_pairs, spanning_links, spanning_pairs
from rowtide.session import settle

WORDS = 4
RADIUS = 4
SEED = 42
# Members that a shard has about, and from which it is divided again.
SHARD = 256
HOT = 1 << 15
# Shards that a fingerprint goes to at most.
CHOICES = 70
# Rows that a task of close pairs looks at together.
GATHERED = 1 << 15


def shingle_hashes(text: bytes, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Hashes of a text's word shingles, in order and repeats included; A-Z are lower-cased."""
    parts = text.lower().split()  # of bytes: ASCII letters and white space only
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.fromiter((digest(line[a:b], seed) for a, b in spans), np.uint64)


def folded(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        piece = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(piece, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of a text's word shingles, repeats included."""
    return folded(shingle_hashes(text, words, seed))


def fingerprints(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    seed: int = SEED,
) -> DataFrame:
    """``_id _check _fp`` of every row: identifier, a hash of the text, fingerprint (as long)."""
    bounded_batches(docs.sparkSession)

    def work(batches):
        for batch in batches:
            texts = batch.column("_text").cast(pa.binary()).to_pylist()
            prints = np.array([fingerprint(t, words, seed) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_check"), pa.array(prints.view(np.int64))],
                ["_id", "_check", "_fp"],
            )

    text = whole(F.col(quoted(text_col)))
    return docs.select(
        F.col(quoted(id_col)).cast("long").alias("_id"),
        raw_hash(text_col).alias("_check"),
        text.alias("_text"),
    ).mapInArrow(work, "_id long, _check long, _fp long")


def block_choices(n: int, radius: int = RADIUS, shard: int | None = None) -> tuple[list[int], list[tuple[int, ...]]]:
    """Blocks (their bits) and the sets of blocks that name shards, for n fingerprints.

    As many blocks must be equal as make shards of about ``SHARD`` members (or ``shard``), or as ``CHOICES`` admits.
    """
    shard, equal = shard or SHARD, 1
    while n > shard << (64 * equal // (radius + equal)) and comb(radius + equal + 1, equal + 1) <= CHOICES:
        equal += 1
    blocks = radius + equal
    bits = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    return bits, list(combinations(range(blocks), equal))


def _shard_keys(value, bits: list[int], choices: list[tuple[int, ...]]):
    """An array of shard names (longs) of a fingerprint column."""
    starts = np.cumsum([0, *bits]).tolist()
    keys = []
    for i, chosen in enumerate(choices):
        mask = sum(((1 << bits[b]) - 1) << starts[b] for b in chosen)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.xxhash64(F.lit(i), value.bitwiseAND(F.lit(mask).cast("long"))))
    return F.array(*keys)


def _by_shard(prints: DataFrame, radius: int, hot: int, shard: int | None = None) -> DataFrame:
    """``_shard _fp`` of distinct fingerprints ``_fp``, the rows of a shard in one partition and side by side."""
    n = prints.count()
    value = F.col("_fp")
    dealt = prints.select("_fp", F.explode(_shard_keys(value, *block_choices(n, radius, shard))).alias("_shard"))
    large = settle(dealt.groupBy("_shard").count().where(F.col("count") > hot).select("_shard"))
    if not large.isEmpty():
        # other block borders: the bits are rotated by half a block
        turned = F.shiftleft(value, 7).bitwiseOR(F.shiftrightunsigned(value, 57))
        again = _shard_keys(turned, *block_choices(n, radius, shard))
        inner = dealt.join(large, "_shard", "left_semi").select(
            "_fp", F.col("_shard").alias("_outer"), F.explode(again).alias("_inner")
        )
        small = dealt.join(large, "_shard", "left_anti").select("_fp", "_shard")
        dealt = small.union(inner.select("_fp", F.xxhash64("_outer", "_inner").alias("_shard")))
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "_shard").sortWithinPartitions("_shard").select("_shard", "_fp")


def links(prints: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """``a b``: links that span all fingerprints ``_fp`` (distinct) within the radius."""

    def work(batches):
        rest_s, rest_f = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            shard = np.concatenate([rest_s, batch.column("_shard").to_numpy()])
            fp = np.concatenate([rest_f, batch.column("_fp").to_numpy().view(np.uint64)])
            if not len(shard):
                continue
            last = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on
            rest_s, rest_f = shard[last:], fp[last:]
            yield _links_of(shard[:last], fp[:last], radius)
        yield _links_of(rest_s, rest_f, radius)

    return _by_shard(prints, radius, hot).mapInArrow(work, "a long, b long")


def close_pairs(prints: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """``a b``, ``a < b``: pairs of fingerprints ``_fp`` (distinct) within the radius.

    They connect what all such pairs connect, shard by shard, and close ones come before others.
    """

    def work(batches):
        rest_s, rest_f = np.empty(0, np.int64), np.empty(0, np.uint64)
        for table in gathered(batches, 16 * GATHERED):
            shard = np.concatenate([rest_s, table.column("_shard").to_numpy()])
            fp = np.concatenate([rest_f, table.column("_fp").to_numpy().view(np.uint64)])
            if not len(shard):
                continue
            last = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on
            rest_s, rest_f = shard[last:], fp[last:]
            yield _pairs_of(shard[:last], fp[:last], radius)
        yield _pairs_of(rest_s, rest_f, radius)

    return _by_shard(prints, radius, hot, LEAF // 2).mapInArrow(work, "a long, b long")


def _shard_ends(shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.flatnonzero(np.diff(shard)) + 1
    return np.concatenate(([0], cuts)), np.concatenate((cuts, [len(shard)]))


def _pairs_of(shard: np.ndarray, fp: np.ndarray, radius: int) -> pa.RecordBatch:
    """Spanning pairs inside each shard of a sorted batch."""
    starts, ends = _shard_ends(shard)
    size = ends - starts
    # shards of a few members side by side: each member against the ones that follow it
    small = np.repeat(size <= LEAF, size)
    s, f = shard[small], fp[small]
    near, away = [np.zeros((2, 0), np.int64)], [np.zeros(0, np.uint8)]
    for step in range(1, int(size[size <= LEAF].max(initial=1))):
        at = np.flatnonzero(s[step:] == s[:-step])
        apart = np.bitwise_count(f[at] ^ f[at + step])
        close = apart <= radius
        near.append(np.stack([at[close], at[close] + step]))
        away.append(apart[close])
    a, b = join_pairs(np.arange(len(f)), *np.concatenate(near, axis=1), np.concatenate(away))
    left, right = [f[a]], [f[b]]
    for a, b in zip(starts[size > LEAF].tolist(), ends[size > LEAF].tolist(), strict=True):
        x, y = spanning_pairs(fp[a:b], radius)
        left.append(x)
        right.append(y)
    left, right = (np.concatenate(x).view(np.int64) for x in (left, right))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right))], ["a", "b"]
    )


def _links_of(shard: np.ndarray, fp: np.ndarray, radius: int) -> pa.RecordBatch:
    """Spanning links inside each shard of a sorted batch."""
    starts, ends = _shard_ends(shard)
    size = ends - starts
    left, right = [], []
    # shards of a few members side by side: each member against the ones that follow it
    small = np.repeat(size <= LEAF, size)
    s, f = shard[small], fp[small]
    labels = np.arange(len(f))
    for step in range(1, int(size[size <= LEAF].max(initial=1))):
        near = (s[step:] == s[:-step]) & (np.bitwise_count(f[step:] ^ f[:-step]) <= radius)
        at = np.flatnonzero(near)
        join_labels(labels, at, at + step)
    moved = np.flatnonzero(labels != np.arange(len(f)))
    left.append(f[moved])
    right.append(f[labels[moved]])
    for a, b in zip(starts[size > LEAF].tolist(), ends[size > LEAF].tolist(), strict=True):
        x, y = spanning_links(fp[a:b], radius)
        left.append(x)
        right.append(y)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], ["a", "b"]
    )


def near_groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``_id _check _fp component_id`` for the rows of ``fingerprints`` (written already)."""
    nodes = settle(
        prints.groupBy("_fp").agg(F.min("_id").alias("_low"), F.count(F.lit(1)).alias("_n"))
    )
    named = components(settle(links(nodes.select("_fp"), radius)))
    linked = settle(named.join(nodes, named["v"] == nodes["_fp"]).select("_fp", "root", "_low"))
    least = linked.groupBy("root").agg(F.min("_low").alias("_component"))
    alone = nodes.where("_n > 1").join(linked.select("_fp"), "_fp", "left_anti")
    place = settle(
        linked.join(least, "root")
        .select("_fp", "_component")
        .union(alone.select("_fp", F.col("_low").alias("_component")))
    )
    return prints.join(place.withColumn("_linked", F.lit(True)), "_fp", "left").select(
        "_id",
        "_check",
        "_fp",
        F.when(F.col("_linked"), F.col("_component")).otherwise(F.col("_id")).alias("component_id"),
    )


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    radius: int = RADIUS,
) -> DataFrame:
    """``doc_id fingerprint component_id``, one row per row of ``docs``."""
    rows = near_groups(settle(fingerprints(docs, id_col, text_col, words)), radius)
    return rows.select(
        F.col("_id").alias("doc_id"),
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one_of_group(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    radius: int = RADIUS,
) -> DataFrame:
    """``docs`` without those that another document of their component stands for."""
    rows = near_groups(settle(fingerprints(docs, id_col, text_col, words)), radius)
    gone = settle(
        rows.where(~F.col("_id").eqNullSafe(F.col("component_id")))
        .select("_id", F.col("_check").alias("_raw"))
        .distinct()
    )
    return without(docs, gone, id_col, text_col)
