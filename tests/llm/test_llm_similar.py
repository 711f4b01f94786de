"""Near-duplicates by shingle overlap against brute force over all pairs."""

from __future__ import annotations

import random

import pytest
from test_llm_text import SF, awkward

import corpus_pipeline
from rowtide.llm import shingle_pairs
from rowtide.llm.shingle_pairs import keep_one_of_similar, similar_groups


def naive_groups(rows):
    """The least identifier of each row's component, over all pairs."""
    sets = []
    for _, text in rows:
        words = text.encode().lower().split()
        sets.append({b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            few, many = sorted((len(sets[i]), len(sets[j])))
            if few >= 0.8 * many and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    low = {}
    for (ident, _), r in zip(rows, root, strict=True):
        low[r] = min(ident, low.get(r, ident))
    return {ident: low[r] for (ident, _), r in zip(rows, root, strict=True)}


def edited(rng, base, edits):
    """``base`` with so many words replaced by words of its own."""
    text = list(base)
    for at in rng.sample(range(len(text)), edits):
        text[at] = f"new{rng.randrange(1 << 40)}"
    return " ".join(text)


@pytest.fixture
def asked(monkeypatch):
    """Pairs that are counted exactly, as they are asked for."""
    pairs = []
    count = shingle_pairs._alike

    def noted(sets, candidates):
        pairs.extend((r.a, r.b) for r in candidates.collect())
        return count(sets, candidates)

    monkeypatch.setattr(shingle_pairs, "_alike", noted)
    return pairs


def test_similar_groups_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(shingle_pairs, "SMALL", 4)
    monkeypatch.setattr(shingle_pairs, "FIRST", 6)
    rng = random.Random(3)
    bases = [[f"w{rng.randrange(5000)}" for _ in range(200)] for _ in range(6)]
    rows = [(i * 7 % 181, edited(rng, bases[i % 6], rng.choice([0, 1, 2, 3, 4, 6, 8])).title()) for i in range(180)]
    rows += [(500 + i, f"short text {i % 3}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = naive_groups(rows)
    assert 4 < len(set(want.values())) < 100
    assert {r._id: r.component_id for r in similar_groups(docs).collect()} == want
    assert {r.doc_id for r in keep_one_of_similar(docs).collect()} == set(want.values())


@pytest.mark.parametrize("edits, most", [(8, 1), (3, 12)])
def test_large_group_takes_few_comparisons(spark, asked, edits, most):
    """300 texts of 300 words: with 8 edits each none are alike (0.57 to 0.61), with 3 some (0.82)."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, edited(rng, base, edits)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r._id: r.component_id for r in similar_groups(docs).collect()}
    assert got == naive_groups(rows)
    assert len(asked) == len(set(asked)) <= most * len(rows)


def test_prefix_misses_no_pair(spark):
    """Recall on given documents: every pair of 0.8 or more is in one component."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r._id: r.component_id for r in similar_groups(docs).collect()} == naive_groups(rows)


def test_stage_removes_every_similar_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").dropDuplicates(["text"])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert {r.doc_id for r in kept.collect()} == set(naive_groups(rows).values())


def test_similar_groups_of_awkward_rows(spark):
    assert similar_groups(awkward(spark)).count() == 9
    assert similar_groups(awkward(spark).limit(0)).collect() == []
