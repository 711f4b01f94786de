"""The near-duplicate stage as SimHash, an exact count, and the pairs that lie further apart."""

from __future__ import annotations

import random

import pytest
from test_llm_rows import clustered, naive_components
from test_llm_similar import edited, naive_groups
from test_llm_text import SF

import corpus_pipeline
from rowtide.llm import shingle_pairs
from rowtide.llm.components import components
from rowtide.llm.shingle_pairs import similar_groups
from rowtide.llm.simhash import close_pairs


def bits(a, b):
    return ((a ^ b) & (1 << 64) - 1).bit_count()


def test_stage_goes_through_fingerprints(spark, monkeypatch):
    """SimHash alone connects alike texts of few differing bits; the prefix filter goes on from there."""
    rng = random.Random(5)
    bases = [[f"w{rng.randrange(5000)}" for _ in range(300)] for _ in range(40)]
    rows = [(i, edited(rng, bases[i % 40], rng.choice([0, 1, 1, 2]))) for i in range(160)]
    rows += [(200 + i, "The Same Set of words " * (2 + i)) for i in range(3)]  # one set, several texts
    prints = {i: shingle_pairs.shingles(t.encode())[1] for i, t in rows}
    given, went = [], []
    close, on = shingle_pairs.close_pairs, shingle_pairs._connected

    def noted(found, radius):
        given.extend(r._fp for r in found.collect())
        pairs = close(found, radius)
        assert all(bits(r.a, r.b) <= radius for r in pairs.collect())
        return pairs

    def then(sets, shared, place, asked):
        number = {r._set: r._id for r in sets.select("_set", "_id").collect()}
        root = {r.v: r.root for r in place.collect()}
        pairs = {(number[r.a], number[r.b]) for r in asked.collect()}
        went.append(({number[v]: number[r] for v, r in root.items()}, pairs))
        return on(sets, shared, place, asked)

    monkeypatch.setattr(shingle_pairs, "close_pairs", noted)
    monkeypatch.setattr(shingle_pairs, "_connected", then)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = naive_groups(rows)
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == set(want.values())
    assert {p & (1 << 64) - 1 for p in given} == set(prints.values()) and len(given) == len(set(given))
    [(root, asked)] = went
    assert all(want[v] == want[r] for v, r in root.items())
    assert len(root) > 100 and len(asked) < 2 * len(rows)


@pytest.mark.parametrize("hot", [1 << 15, 6])
def test_close_pairs_span_what_brute_force_does(spark, hot):
    """All bits of a few clusters, one of them larger than a leaf of a tree."""
    values = clustered(7, 300)
    values = list(dict.fromkeys(values + [values[0] ^ a for a in range(150)]))
    signed = [(v - (1 << 64) if v >= 1 << 63 else v,) for v in values]
    pairs = close_pairs(spark.createDataFrame(signed, "_fp long"), 6, hot).collect()
    assert all(r.a < r.b and bits(r.a, r.b) <= 6 for r in pairs)
    root = {r.v: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = naive_components(values, 6)
    got = [root.get(s[0], s[0]) for s in signed]
    assert len(set(want)) == len(set(got)) == len(set(zip(want, got, strict=True)))


def test_pairs_beyond_the_radius_are_found(spark):
    """Texts that overlap by 0.8 and differ in more bits than SimHash looks at."""
    rng = random.Random(6)
    rows, far = [], 0
    while far < 5:
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        pair = [" ".join(base), edited(rng, base, 2)]
        apart = bits(*(shingle_pairs.shingles(t.encode())[1] for t in pair))
        if apart > shingle_pairs.RADIUS:
            far += 1
            rows += [(len(rows) + i, t) for i, t in enumerate(pair)]
    want = naive_groups(rows)
    assert len(set(want.values())) == 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r._id: r.component_id for r in similar_groups(docs).collect()} == want
