"""Merkle manifest of a table: subtree exchange by cogrouped superblocks.

Every row is a leaf, the leaves of a source form a tree of runs of ``ARITY`` consecutive
nodes, and the subroots of the sources form the tree above. Consecutive leaves are cut
into *superblocks* of ``ARITY ** HEIGHT``, each a whole subtree; sources that are smaller
share a block with their neighbours. Going up, a block is reduced to its top, and the
tops, thousands of times fewer, are nodes of the next round. Going down, the blocks are
cogrouped with the outer nodes they need, the siblings on the way from their top to the
root, which finishes everything in one exchange: the local reduction, the joining of
inner and outer proofs, and the folding of every leaf along its proof.

Only digests are exchanged, texts never. A source of any size is cut into blocks of
``ARITY ** HEIGHT`` leaves; any number of small sources are dealt into blocks of at most
twice as many.

Defined results: a null field is hashed as ``-``; a null source comes first and is a
source like any other; null identifiers come first in their source and are not tampered
with; rows with equal identifiers are leaves of their own, in the order of their digests;
an empty table gives no rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtide.llm.common import broadcast_small, quoted
from rowtide.llm.prefix import prefix_sums
from rowtide.session import settle

ARITY = 3
# Levels of a superblock: 6,561 leaves.
HEIGHT = 8
# Sources (a name and three longs) that are broadcast at most.
BROADCAST_SOURCES = 1 << 18

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODE = "_of_a long, _of_b long, tree long, pos long, n long, start long, digest binary"
_PATH = (
    "_of_a long, _of_b long, tree long, pos long, node string, lefts array<string>, "
    "rights array<string>, subroot string, root string"
)


def joined_hash(parts: str) -> str:
    """The digest of digests written one after the other as hex."""
    return sha256(parts.encode()).hexdigest()


def field(value: Column) -> Column:
    """A field as it is hashed: ``-``, or its length in bytes, a colon and itself; binary."""
    raw = value.cast("string").cast("binary")
    size = F.concat(F.octet_length(raw).cast("string"), F.lit(":")).cast("binary")
    return F.coalesce(F.concat(size, raw), F.lit(b"-"))


def row_digest(values: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def leaves(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """``_id _source digest _other _uid``: each row's digest, and that of the row tampered with.

    Tampered with are rows of an identifier whose CRC-32 is even: the text loses its line
    ends. ``_other`` is null for the rest. Written once.
    """
    own = [F.col(quoted(c)) for c in fields]
    changed = [F.translate(v, "\n", "") if c == text_col else v for c, v in zip(fields, own, strict=True)]
    chosen = F.crc32(F.col(quoted(id_col)).cast("string")) % 2 == 0
    return settle(
        docs.select(
            F.col(quoted(id_col)).alias("_id"),
            F.col(quoted(source_col)).alias("_source"),
            row_digest(own).alias("digest"),
            F.when(chosen, row_digest(changed)).alias("_other"),
            F.monotonically_increasing_id().alias("_uid"),
        )
    )


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with their tree (the number of the source), place, size of tree and its start."""
    one = rows.withColumn("_one", F.lit(1).cast("long"))
    ordered = prefix_sums(one, ["_source", "_id", "digest", "_uid"], "_one", "_at")
    sources = ordered.groupBy("_source").agg(F.sum("_one").alias("n"), F.min("_at").alias("start"))
    sources = settle(sources.withColumn("_one", F.lit(1).cast("long")))
    trees = settle(prefix_sums(sources, ["_source"], "_one", "tree").withColumnRenamed("_source", "_name"))
    trees = broadcast_small(trees.drop("_one"), BROADCAST_SOURCES)
    return ordered.join(trees, F.col("_source").eqNullSafe(F.col("_name"))).select(
        "_id", "_other", "digest", "tree", (F.col("_at") - F.col("start")).alias("pos"), "n", "start"
    )


def subtree(nodes: list[str], height: int | None, arity: int = ARITY) -> list[list[str]]:
    """``nodes`` and the levels above them: so many, or as many as leave one node."""
    levels = [nodes]
    while len(levels) <= height if height is not None else len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([joined_hash("".join(low[i : i + arity])) for i in range(0, len(low), arity)])
    return levels


def siblings(levels: list[list[str]], at: int, arity: int = ARITY) -> tuple[list[str], list[str]]:
    """What stands left and right of a node in its run, level by level."""
    lefts, rights = [], []
    for nodes in levels[:-1]:
        run = at - at % arity
        lefts.append("".join(nodes[run:at]))
        rights.append("".join(nodes[at + 1 : run + arity]))
        at //= arity
    return lefts, rights


def fold(node: str, lefts: Sequence[str], rights: Sequence[str]) -> str:
    """The root that a node leads to along its siblings."""
    for left, right in zip(lefts, rights, strict=True):
        node = joined_hash(left + node + right)
    return node


def _blocks(nodes: DataFrame, span: int) -> DataFrame:
    """``nodes`` with the block ``_a _b`` that each is reduced in: a part of a large tree, or
    the whole trees that begin in one span of leaves."""
    large = F.col("n") > span
    return nodes.withColumns(
        {
            "_a": F.when(large, F.col("tree")).otherwise(F.lit(-1)).cast("long"),
            "_b": F.floor(F.when(large, F.col("pos")).otherwise(F.col("start")) / F.lit(span)).cast("long"),
        }
    )


def _trees(rows: pd.DataFrame, height: int, arity: int) -> Iterator[tuple[int, int, np.ndarray, list[list[str]]]]:
    """The trees, or the part of one, in a block: tree, size, places of the rows, levels."""
    trees, sizes = rows["tree"].to_numpy(), rows["n"].to_numpy()
    order = np.lexsort((rows["pos"].to_numpy(), trees))
    trees, sizes = trees[order], sizes[order]
    digests = [bytes(d).hex() for d in rows["digest"].to_numpy()[order]]
    starts = np.flatnonzero(np.concatenate(([True], trees[1:] != trees[:-1]))).tolist()
    for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
        n = int(sizes[a])
        yield int(trees[a]), n, order[a:b], subtree(digests[a:b], height if n > arity**height else None, arity)


def tops(nodes: DataFrame, height: int = HEIGHT, arity: int = ARITY) -> DataFrame:
    """One round up: the top of each block as a node of the next round; written once.

    ``_of_a _of_b`` name the block that a node is the top of.
    """
    span = arity**height

    def reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        pos, start = rows["pos"].to_numpy(), rows["start"].to_numpy()
        for tree, n, at, levels in _trees(rows, height, arity):
            place, left = (int(pos[at[0]]) // span, -(-n // span)) if n > span else (0, 1)
            found.append((*key, tree, place, left, int(start[at[0]]), bytes.fromhex(levels[-1][0])))
        return pd.DataFrame(found, columns=["_of_a", "_of_b", "tree", "pos", "n", "start", "digest"])

    slim = _blocks(nodes.select("tree", "pos", "n", "start", "digest"), span)
    return settle(slim.groupBy("_a", "_b").applyInPandas(reduce, _NODE))


def _rounds(nodes: DataFrame, height: int, arity: int) -> list[DataFrame]:
    """``nodes`` and the rounds above them, up to the first in which every tree is one node."""
    found = [nodes]
    while not found[-1].where("n > 1").isEmpty():
        found.append(tops(found[-1], height, arity))
    return found


def _descend(nodes: DataFrame, outer: DataFrame, height: int, arity: int) -> DataFrame:
    """The path to the root of every node, from the paths of the tops one round up; written once."""

    def join(inner: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        found = []
        ways = {w.tree: w for w in above.itertuples(index=False)}
        of_a, of_b, pos = (inner[c].to_numpy() for c in ("_of_a", "_of_b", "pos"))
        for tree, _, at, levels in _trees(inner, height, arity):
            way = ways[tree]
            for i, row in enumerate(at.tolist()):
                lefts, rights = siblings(levels, i, arity)
                sides = [*lefts, *way.lefts], [*rights, *way.rights]
                found.append((of_a[row], of_b[row], tree, pos[row], levels[0][i], *sides, way.subroot, way.root))
        columns = ["_of_a", "_of_b", "tree", "pos", "node", "lefts", "rights", "subroot", "root"]
        return pd.DataFrame(found, columns=columns)

    outer = outer.withColumnsRenamed({"_of_a": "_a", "_of_b": "_b"})
    mine = _blocks(nodes, arity**height).groupBy("_a", "_b")
    return settle(mine.cogroup(outer.groupBy("_a", "_b")).applyInPandas(join, _PATH))


def outer_paths(rows: DataFrame, height: int = HEIGHT, arity: int = ARITY) -> DataFrame:
    """For every block of leaves and each tree in it, the path from its top to the root."""
    first = tops(rows, height, arity)
    inside = _rounds(first, height, arity)
    count = F.lit(inside[-1].count()).cast("long")
    above = inside[-1].select(
        "_of_a", "_of_b", F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), count.alias("n"),
        F.lit(0).cast("long").alias("start"), "digest",
    )
    above = _rounds(above, height, arity)
    none = F.array().cast("array<string>")
    node = F.lower(F.hex("digest"))
    paths = above[-1].select(
        "_of_a", "_of_b", "tree", "pos", node.alias("node"), none.alias("lefts"), none.alias("rights"),
        F.lit(None).cast("string").alias("subroot"), node.alias("root"),
    )
    for nodes in reversed(above[:-1]):
        paths = _descend(nodes, paths, height, arity)
    # a node of the tree of sources is a source's subroot
    paths = paths.withColumns({"tree": F.col("pos"), "subroot": F.col("node")})
    for nodes in reversed(inside[:-1]):
        paths = _descend(nodes, paths, height, arity)
    return paths


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    height: int = HEIGHT,
    arity: int = ARITY,
) -> DataFrame:
    """``doc_id leaf subroot root proof_sha256 folded_root verified`` of every row.

    ``folded_root`` is what the leaf of the row, tampered with or not, gives along the proof.
    """
    rows = settle(placed(leaves(docs, fields, id_col, source_col, text_col)))
    kind = rows.schema["_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string, verified boolean"
    )

    def finish(inner: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        found, places = [], []
        ways = {w.tree: w for w in above.itertuples(index=False)}
        others = inner["_other"].to_numpy()
        for tree, _, at, levels in _trees(inner, height, arity):
            way = ways[tree]
            for i, row in enumerate(at.tolist()):
                leaf, other = levels[0][i], others[row]
                lefts, rights = siblings(levels, i, arity)
                lefts, rights = [*lefts, *way.lefts], [*rights, *way.rights]
                proof = joined_hash("".join(a + b for a, b in zip(lefts, rights, strict=True)))
                folded = fold(leaf if other is None else bytes(other).hex(), lefts, rights)
                found.append((leaf, way.subroot, way.root, proof, folded, folded == way.root))
            places.append(at)
        columns = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        out = pd.DataFrame(found, columns=columns)
        out.insert(0, "doc_id", inner["_id"].iloc[np.concatenate(places)].reset_index(drop=True))
        return out

    outer = outer_paths(rows, height, arity).select(
        F.col("_of_a").alias("_a"), F.col("_of_b").alias("_b"), "tree", "lefts", "rights", "subroot", "root"
    )
    mine = _blocks(rows, arity**height).groupBy("_a", "_b")
    return mine.cogroup(outer.groupBy("_a", "_b")).applyInPandas(finish, schema)
