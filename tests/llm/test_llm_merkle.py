"""The Merkle manifest against a plain tree built in memory."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

import pytest
from test_llm_text import awkward

from rowtide.llm.merkle import manifest

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(row, text):
    out = b""
    for value in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text):
        raw = None if value is None else str(value).encode()
        out += b"-" if raw is None else str(len(raw)).encode() + b":" + raw
    return sha256(out).hexdigest()


def hashed(parts):
    return sha256("".join(parts).encode()).hexdigest()


def path_of(nodes, at):
    """Siblings (before, after) of each level and the root."""
    path = []
    while len(nodes) > 1:
        run = at // 3 * 3
        path.append((nodes[run:at], nodes[at + 1 : run + 3]))
        nodes, at = [hashed(nodes[i : i + 3]) for i in range(0, len(nodes), 3)], at // 3
    return path, nodes[0]


def naive(rows):
    """Each row's expected result, as a list."""
    by_source = {}
    for row in rows:
        by_source.setdefault(row["source"], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for part in by_source.values():
        part.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
    trees = {s: [leaf_of(r, r["text"]) for r in part] for s, part in by_source.items()}
    subroots = [path_of(trees[s], 0)[1] for s in names]
    out = []
    for s, part in by_source.items():
        for i, row in enumerate(part):
            inner, subroot = path_of(trees[s], i)
            above, root = path_of(subroots, names.index(s))
            path = inner + above
            proof = hashed([d for before, after in path for d in (*before, *after)])
            text = row["text"]
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            node = leaf_of(row, text)
            for before, after in path:
                node = hashed([*before, node, *after])
            out.append((row["doc_id"], trees[s][i], subroot, root, proof, node, node == root))
    return sorted(out, key=str)


def sample(n, sources, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = None if rng.random() < 0.02 else sources[min(int(rng.expovariate(0.7)), len(sources) - 1)]
        text = None if i % 17 == 0 else "a\nb é" * rng.randint(0, 4)
        rows.append((rng.randrange(3 * n), source, rng.choice([None, "en", ""]), rng.choice([None, i]), text))
    return rows + rows[:3] + [(None, "s0", None, None, "x\ny"), (None, None, None, None, None)]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("height, sources", [(2, 6), (1, 40), (8, 3)])
def test_manifest_equals_plain_tree(spark, height, sources):
    rows = sample(260, ["", "Z", "a", "é", *[f"s{i}" for i in range(sources)]])
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    want = naive([r.asDict() for r in docs.collect()])
    got = manifest(docs, height=height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert 0 < sum(not r[-1] for r in want) < len(want)


def test_each_row_its_own_source_and_one_row(spark):
    rows = [(i, f"site{i:03}", "en", i, "t\n") for i in range(60)]
    for part in (rows, rows[:1]):
        docs = spark.createDataFrame(part, SCHEMA)
        want = naive([r.asDict() for r in docs.collect()])
        assert sorted(map(tuple, manifest(docs, height=2).collect()), key=str) == want


def test_manifest_of_awkward_rows(spark):
    from pyspark.sql import functions as F

    docs = awkward(spark).withColumns({"n_chars": F.lit(3).cast("long"), "tree": F.lit(1), "_a": F.lit(2)})
    want = naive([r.asDict() for r in docs.collect()])
    assert sorted(map(tuple, manifest(docs).collect()), key=str) == want
    assert manifest(docs.limit(0)).collect() == []
