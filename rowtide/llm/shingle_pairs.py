"""Near-duplicates by SimHash and overlap: components of texts whose word shingles are alike.

Two texts are near-duplicates if the Jaccard likeness of their sets of ``WORDS``-word
shingles is ``LIKE`` or more, counted exactly.

*SimHash* comes first: each set has a 64-bit fingerprint, and those that differ in up to
``RADIUS`` bits are found in shards of equal blocks, by vantage-point trees. Each set's nearest
one is counted, then the nearest beyond each component that has grown, until none grows.

A fingerprint only estimates the likeness, and pairs of ``LIKE`` may differ in more bits than any
radius that shards can carry. So what is not connected by then has an exact way, which starts from those components:
a *prefix filter*, which misses no pair. Two sets of likeness t share one of their first n - ceil(t n) + 1 shingles in
any one order of all shingles. The order is rarest first, by a table of ``SLOTS`` counters
over all sets and then by hash, so that private edits fill the prefixes and what many texts
share comes last. Where the first common shingle stands bounds how many can be common: pairs
that cannot reach the likeness are not looked at, and the rest are counted exactly.

Equal shingle sets are first reduced to one. Of a shingle that up to ``SMALL`` sets have in
their prefix all pairs are candidates. Of a more common one a few sets are compared with all
others, then ``GROWTH`` times as many, and so on; what is connected by then is not compared
again, and a set that can reach the likeness with no other is left out. So a large group of
near-copies takes a few comparisons each, and no pair that could still join two components is
left out. Only groups of texts that all stay just below the likeness, each with few edits of
its own, cost more than that.

Defined results: texts without words are alike, texts of fewer than ``WORDS`` words have
one shingle; null identifiers never name a component; rows with equal identifiers are
rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowtide.llm.common import BROADCAST_ROWS, bounded_batches, broadcast_small, quoted, raw_hash, whole, without
from rowtide.llm.components import components
from rowtide.llm.simhash import close_pairs, folded, shingle_hashes
from rowtide.session import settle

WORDS = 5
LIKE = 0.8
# Differing bits of fingerprints up to which sets are looked at.
RADIUS = 6
# Counters of the table that says how common shingles are, about; and its parts and how many are added at once.
SLOT_BITS = 22
BLOCK_BITS = 16
MERGED = 256
# Counted sets from which a shingle is hot: up to here all its rows may meet in a task.
HOT = 1 << 13
# Sets of a shingle that are all compared, those of a larger one that are compared first (expected), and the growth.
SMALL = 16
FIRST = 8
GROWTH = 4
# Shingles of the sets on one side of the comparisons up to which they are broadcast: 8 MB.
BROADCAST_GRAMS = 1 << 20

_ROUNDING = 1e-9


def shingles(text: bytes, words: int = WORDS) -> tuple[np.ndarray, int]:
    """The set of a text's word shingles as ascending 48-bit hashes, and its SimHash.

    That two of the shingles of a pair of texts share a hash has odds of one in a billion.
    """
    hashes = np.unique(shingle_hashes(text, words))
    return np.unique(hashes >> np.uint64(16)), folded(hashes)


def packed(grams: np.ndarray) -> bytes:
    """Shingles in six bytes each."""
    return grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_set _id _check _name _fp _n _grams`` of every row.

    A number for its set, hashes of text and shingles, the fingerprint and the shingles.
    """
    bounded_batches(docs.sparkSession)

    def work(batches):
        for batch in batches:
            found = [shingles(t) for t in batch.column("_text").cast(pa.binary()).to_pylist()]
            sets = [s for s, _ in found]
            prints = np.array([p for _, p in found], np.uint64)
            names = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("_set", "_id", "_check")),
                    pa.array(names.view(np.int64)),
                    pa.array(prints.view(np.int64)),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([packed(s) for s in sets], pa.binary()),
                ],
                ["_set", "_id", "_check", "_name", "_fp", "_n", "_grams"],
            )

    return docs.select(
        F.monotonically_increasing_id().alias("_set"),
        F.col(quoted(id_col)).cast("long").alias("_id"),
        raw_hash(text_col).alias("_check"),
        whole(F.col(quoted(text_col))).alias("_text"),
    ).mapInArrow(work, "_set long, _id long, _check long, _name long, _fp long, _n int, _grams binary")


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How often the shingles of each slot occur, over all sets: a table of fixed size."""
    slots, blocks = 1 << SLOT_BITS, 1 << (SLOT_BITS - BLOCK_BITS)
    shift = np.uint64(48 - SLOT_BITS)

    def partial(batches):
        table, held, size = np.zeros(slots, np.uint32), [], 0
        for batch in batches:
            for grams in batch.column("_grams").to_pylist():
                held.append((unpacked(grams) >> shift).astype(np.int64))
                size += len(held[-1])
            if size > slots // 4:
                table += np.bincount(np.concatenate(held), minlength=slots).astype(np.uint32)
                held, size = [], 0
        if held:
            table += np.bincount(np.concatenate(held), minlength=slots).astype(np.uint32)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(blocks, dtype=np.int32)),
                pa.array(np.full(blocks, part, np.int32)),
                pa.array([zlib.compress(b.tobytes(), 1) for b in table.reshape(blocks, -1)], pa.binary()),
            ],
            ["_block", "_part", "_counts"],
        )

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(c), np.uint32) for c in rows["_counts"])
        first = rows.iloc[[0]][["_block", "_part"]]
        return first.assign(_part=first["_part"] // MERGED, _counts=[zlib.compress(total.tobytes(), 1)])

    schema = "_block int, _part int, _counts binary"
    tables = settle(sets.select("_grams").mapInArrow(partial, schema))
    while True:
        most = tables.agg(F.max("_part")).first()[0]
        if not most:
            break
        near = F.floor(F.col("_part") / MERGED)
        tables = settle(tables.groupBy("_block", near.alias("_near")).applyInPandas(add, schema))
    out = np.zeros((blocks, 1 << BLOCK_BITS), np.uint32)
    for row in tables.select("_block", "_counts").collect():  # 16 MB at most
        out[row["_block"]] = np.frombuffer(zlib.decompress(row["_counts"]), np.uint32)
    return np.minimum(out.reshape(-1), np.iinfo(np.uint16).max).astype(np.uint16)


def prefix_length(n: int, like: float = LIKE) -> int:
    return n - math.ceil(like * n - _ROUNDING) + 1 if n else 0


def _postings(sets: DataFrame, counts: np.ndarray, hot: bool) -> DataFrame:
    """``_gram _set _n _p``: the shingles of each set's prefix, and where they stand in it.

    Those that are ``hot`` or those that are not.
    """
    shift = np.uint64(48 - SLOT_BITS)

    def work(batches):
        for batch in batches:
            grams, places = [], []
            for raw in batch.column("_grams").to_pylist():
                own = unpacked(raw)
                often = counts[(own >> shift).astype(np.int64)]
                first = np.lexsort((own, often))[: prefix_length(len(own))]
                at = np.flatnonzero((often[first] > HOT) == hot)
                grams.append(own[first[at]])
                places.append(at.astype(np.int32))
            at = pa.array(np.repeat(np.arange(len(grams)), [len(g) for g in grams]))
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (grams, places)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(flat[0].astype(np.int64)),
                    batch.column("_set").take(at),
                    batch.column("_n").take(at),
                    pa.array(flat[1].astype(np.int32)),
                ],
                ["_gram", "_set", "_n", "_p"],
            )

    return sets.select("_set", "_n", "_grams").mapInArrow(work, "_gram long, _set long, _n int, _p int")


def _shared(sets: DataFrame, counts: np.ndarray) -> DataFrame:
    """``_gram _set _n _p _members``: what stands in the prefixes of several sets; written once.

    A shingle is counted no less often than it occurs, so one that is not hot has a bounded number
    of rows, which are exchanged once and counted where they meet. Hot ones are
    counted before the exchange.
    """
    members = F.count(F.lit(1)).over(Window.partitionBy("_gram")).cast("long")
    found = settle(_postings(sets, counts, False).withColumn("_members", members).where("_members > 1"))
    if not (counts > HOT).any():
        return found
    hot = settle(_postings(sets, counts, True))
    sizes = settle(hot.groupBy("_gram").agg(F.count(F.lit(1)).alias("_members")).where("_members > 1"))
    return found.union(hot.join(broadcast_small(sizes, BROADCAST_ROWS), "_gram").select(found.columns))


def _reach(n: Column, m: Column) -> Column:
    """How many common shingles sets of two sizes need."""
    return F.lit(LIKE / (1 + LIKE)) * (n + m) - F.lit(_ROUNDING)


def _sizes_fit() -> Column:
    """Whether sets of sizes ``_n`` and ``_m`` may be alike."""
    return F.least("_n", "_m") >= F.lit(LIKE) * F.greatest("_n", "_m") - F.lit(_ROUNDING)


def _possible() -> Column:
    """Whether two sets may be alike that share the shingles at places ``_p`` and ``_q``, of sizes ``_n`` and ``_m``.

    Of their common shingles in order, the first stands at these places, or this pair is found by another one.
    """
    left = F.least(F.col("_n") - F.col("_p"), F.col("_m") - F.col("_q"))
    return _sizes_fit() & (left >= _reach(F.col("_n"), F.col("_m")))


def _alike(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (``a b`` of sets and more columns, written already) that are alike, counted exactly."""
    wanted = settle(pairs.select(F.col("a").alias("_set")).union(pairs.select("b")).distinct())
    grams = settle(sets.select("_set", "_n", "_grams").join(broadcast_small(wanted, BROADCAST_ROWS), "_set"))
    left = grams.join(pairs.select(F.col("a").alias("_set")).distinct(), "_set", "left_semi")
    left = settle(left.select(F.col("_set").alias("a"), "_n", F.col("_grams").alias("_x")))
    if (left.agg(F.sum("_n")).first()[0] or 0) <= BROADCAST_GRAMS:
        left = F.broadcast(left)
    right = grams.select(F.col("_set").alias("b"), F.col("_grams").alias("_y"))
    names = pairs.columns

    def count(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("_x").to_pylist(), batch.column("_y").to_pylist(), strict=True):
                x, y = unpacked(x), unpacked(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= LIKE * (len(x) + len(y) - both) - _ROUNDING)
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(right, "b").join(left.drop("_n"), "a").select(*names, "_x", "_y")
    return both.mapInArrow(count, pairs.schema)


def _joined(place: DataFrame | None, links: DataFrame) -> DataFrame:
    """``v root`` after more ``links`` (``a b`` of components' names, or of sets that have none yet)."""
    new = settle(components(links))
    if place is None:
        return new
    moved = place.join(new.select(F.col("v").alias("root"), F.col("root").alias("_to")), "root", "left")
    moved = moved.select("v", F.coalesce("_to", "root").alias("root"))
    return settle(moved.union(new.join(place.select("v"), "v", "left_anti")))


def _named(pairs: DataFrame, place: DataFrame | None) -> DataFrame:
    """Those of ``pairs`` (``a b`` of sets) that lie in two components, with their names ``_of _part``."""
    if place is None:
        return pairs.withColumns({"_of": F.col("a"), "_part": F.col("b")})
    names = broadcast_small(place, BROADCAST_ROWS)
    for end, name in (("a", "_of"), ("b", "_part")):
        named = names.select(F.col("v").alias(end), F.col("root").alias("_root"))
        pairs = pairs.join(named, end, "left").withColumn(name, F.coalesce("_root", end)).drop("_root")
    return pairs.where("_of <> _part")


def _unasked(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """``pairs`` without those that have been counted (``a < b``, written already)."""
    asked = broadcast_small(asked.select(F.col("a").alias("_a"), F.col("b").alias("_b")), BROADCAST_ROWS)
    same = (F.least("a", "b") == F.col("_a")) & (F.greatest("a", "b") == F.col("_b"))
    return pairs.join(asked, same, "left_anti")


def _near(sets: DataFrame) -> DataFrame:
    """``a b _away``: pairs of sets, ``a < b``, that connect all whose fingerprints differ in few bits.

    Of equal fingerprints, the first set stands for the others and is paired with each of them.
    """
    head = F.min(F.struct("_set", "_n"))
    prints = settle(sets.groupBy("_fp").agg(head.alias("_head"), F.count(F.lit(1)).alias("_sets")))
    heads = prints.select("_fp", F.col("_head._set").alias("a"), F.col("_head._n").alias("_m"), "_sets")
    again = broadcast_small(settle(heads.where("_sets > 1").drop("_sets")), BROADCAST_ROWS)
    equal = sets.select("_fp", F.col("_set").alias("b"), "_n").join(again, "_fp").where("a <> b")
    equal = equal.select("a", "b", "_m", "_n", F.lit(0).alias("_away"))
    near = settle(close_pairs(prints.select("_fp"), RADIUS).toDF("_x", "_y").distinct())
    left = heads.select(F.col("_fp").alias("_x"), "a", "_m")
    right = heads.select(F.col("_fp").alias("_y"), F.col("a").alias("b"), F.col("_m").alias("_n"))
    away = F.bit_count(F.col("_x").bitwiseXOR(F.col("_y"))).alias("_away")
    near = near.join(left, "_x").join(right, "_y").select("a", "b", "_m", "_n", away)
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return settle(equal.union(near).where(_sizes_fit()).select(low, high, "_away"))


def _by_fingerprints(sets: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """``v root`` of the sets that SimHash connects, if any, and the pairs ``a b`` that were counted for it."""
    left, place, grown, asked = _named(_near(sets), None), None, None, None
    while True:
        near = F.struct("_away", "a", "b", "_of", "_part").alias("_near")
        sides = left.select(F.col("_of").alias("_name"), near).union(left.select("_part", near))
        if grown is not None:
            sides = sides.join(broadcast_small(grown, BROADCAST_ROWS), "_name", "left_semi")
        nearest = sides.groupBy("_name").agg(F.min("_near").alias("_near"))
        pairs = settle(nearest.select("_near.a", "_near.b", "_near._of", "_near._part").distinct())
        new = pairs.select("a", "b")
        asked = new if asked is None else asked.union(new)
        if pairs.isEmpty():
            return place, asked
        found = settle(_alike(sets, pairs))
        if found.isEmpty():
            return place, asked
        place = _joined(place, found.select(F.col("_of").alias("a"), F.col("_part").alias("b")))
        grown = found.select(F.col("a").alias("v")).join(place, "v").select(F.col("root").alias("_name"))
        grown = settle(grown.distinct())
        left = settle(_named(_unasked(left.drop("_of", "_part"), new), place))


def _connected(sets: DataFrame, shared: DataFrame, place: DataFrame | None, asked: DataFrame) -> DataFrame:
    """``v root`` of the sets that are alike to another, from ``_gram _set _n _p _members``.

    It goes on from what is in ``place`` and does not count again what was ``asked``.
    """
    small = shared.where(F.col("_members") <= SMALL)
    other = small.select("_gram", F.col("_set").alias("b"), F.col("_n").alias("_m"), F.col("_p").alias("_q"))
    pairs = small.withColumnRenamed("_set", "a").join(other, "_gram").where(_possible() & (F.col("a") < F.col("b")))
    pairs = settle(pairs.select("a", "b").distinct())
    found = settle(_alike(sets, settle(_unasked(_named(pairs, place), asked))))
    place = _joined(place, found.select(F.col("_of").alias("a"), F.col("_part").alias("b")))
    # when a set comes in its turn: in [0, 1), the same for all of its shingles
    turn = F.shiftrightunsigned(F.xxhash64("_set"), 11) / F.lit(float(1 << 53))
    large = shared.where(F.col("_members") > SMALL)
    members = settle(
        large.join(place, F.col("_set") == F.col("v"), "left").select(
            "_gram", "_set", "_n", "_p", (turn * F.col("_members")).alias("_turn"),
            F.coalesce("root", "_set").alias("_part"),
        )
    )
    most = large.agg(F.max("_members")).first()[0] or 0
    done, now = 0, FIRST
    while done < most:
        # without the sets that can be alike to none of their shingle's, and shingles whose sets are one component
        least = broadcast_small(settle(members.groupBy("_gram").agg(F.min("_n").alias("_least"))), BROADCAST_ROWS)
        fits = F.greatest(F.col("_least").cast("double"), F.lit(LIKE) * F.col("_n"))
        members = members.join(least, "_gram").where(F.col("_n") - F.col("_p") >= _reach(F.col("_n"), fits))
        members = settle(members.drop("_least"))
        open_ = members.groupBy("_gram").agg(F.min("_part").alias("_low"), F.max("_part").alias("_high"))
        open_ = settle(open_.where("_low <> _high").select("_gram"))
        if open_.isEmpty():
            break
        # the sets of earlier turns have been compared with all
        left = members.join(broadcast_small(open_, BROADCAST_ROWS), "_gram", "left_semi").where(F.col("_turn") >= done)
        heads = settle(
            left.where(F.col("_turn") < now).select(
                "_gram", F.col("_set").alias("a"), F.col("_n").alias("_m"), F.col("_p").alias("_q"),
                F.col("_part").alias("_of"),
            )
        )
        heads = broadcast_small(heads, BROADCAST_ROWS)
        # of two heads one asks
        asks = (F.col("_turn") >= now) | (F.col("a") < F.col("_set"))
        met = left.join(heads, "_gram").where(asks & (F.col("_of") != F.col("_part")) & _possible())
        pairs = met.select("a", F.col("_set").alias("b"), "_of", "_part").distinct()
        pairs = settle(_unasked(pairs, asked))
        found = settle(_alike(sets, pairs))
        if not found.isEmpty():
            links = found.select(F.col("_of").alias("a"), F.col("_part").alias("b")).distinct()
            place = _joined(place, links)
            members = settle(
                members.join(place, F.col("_set") == F.col("v"), "left").select(
                    "_gram", "_set", "_n", "_p", "_turn", F.coalesce("root", "_part").alias("_part")
                )
            )
        done, now = now, GROWTH * now + FIRST
    return place


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id _check component_id`` of every row."""
    rows = settle(_sketches(docs, id_col, text_col))
    nodes = settle(
        rows.groupBy("_name").agg(
            F.min("_id").alias("_low"), F.count(F.lit(1)).alias("_rows"), F.min("_set").alias("_first")
        )
    )
    again = nodes.where("_rows > 1").select("_name", "_first")
    again = rows.select("_name", "_set").join(broadcast_small(again, BROADCAST_ROWS), "_name")
    again = settle(again.where("_set <> _first").select("_set"))
    sets = rows.join(broadcast_small(again, BROADCAST_ROWS), "_set", "left_anti")
    place, asked = _by_fingerprints(sets)
    place = _connected(sets, _shared(sets, shingle_counts(sets)), place, asked)
    place = place.join(nodes, F.col("v") == F.col("_first")).select("_name", "root", "_low")
    place = settle(place)
    least = place.groupBy("root").agg(F.min("_low").alias("_component"))
    alone = nodes.where("_rows > 1").join(place.select("_name"), "_name", "left_anti")
    named = place.join(least, "root").select("_name", "_component")
    named = settle(named.union(alone.select("_name", F.col("_low").alias("_component"))))
    named = broadcast_small(named, BROADCAST_ROWS).withColumn("_linked", F.lit(True))
    out = rows.select("_id", "_check", "_name").join(named, "_name", "left")
    component = F.when(F.col("_linked"), F.col("_component")).otherwise(F.col("_id"))
    return out.select("_id", "_check", component.alias("component_id"))


def keep_one_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that another document of their component stands for."""
    rows = similar_groups(docs, id_col, text_col)
    gone = settle(
        rows.where(~F.col("_id").eqNullSafe(F.col("component_id")))
        .select("_id", F.col("_check").alias("_raw"))
        .distinct()
    )
    return without(docs, gone, id_col, text_col)
