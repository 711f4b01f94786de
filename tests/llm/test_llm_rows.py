"""Deduplication, sharding, packing and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import random
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_llm_similar import naive_groups
from test_llm_text import awkward

import corpus_pipeline
from rowtide.llm import simhash
from rowtide.llm.components import components
from rowtide.llm.exact_dedup import digests, exact_groups, keep_one, merge_runs
from rowtide.llm.line_dedup import remove_spread_lines
from rowtide.llm.packing import LENGTHS, pack, pack_documents
from rowtide.llm.sharding import communication_matrix, hypergeometric, shuffle_into_shards
from rowtide.llm.simhash import fingerprint, keep_one_of_group, links, simhash_components
from rowtide.llm.vptree import VantageTree, spanning_links

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def folded(text):
    return (text or "").translate(FOLD)


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=str)


def test_exact_groups_of_awkward_rows(spark):
    docs = awkward(spark).repartition(5)
    groups = defaultdict(list)
    for r in docs.collect():
        groups[folded(r.text)].append(r.doc_id)
    want = set()
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        want |= {(i, best, len(ids), i == best, digest) for i in ids}
    assert sorted_rows(exact_groups(docs).collect()) == sorted_rows(want)
    assert exact_groups(docs.limit(0)).collect() == []


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_rounds_of_any_order_agree(spark, bits):
    rows = [(i, f"t{i % 7}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(13)
    merged = merge_runs(digests(docs), bits, keep="smallest").collect()
    assert sorted((r._best, r._n) for r in merged) == [(i, 13 if i < 6 else 12) for i in range(7)]


def test_keep_one_leaves_one_row(spark):
    docs = awkward(spark)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    texts = [folded(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({folded(r.text) for r in docs.collect()})


def test_spread_lines_by_definition(spark):
    rng = random.Random(5)
    pool = [f"line number {i}" for i in range(40)]
    rows = []
    for i in range(300):
        text = "\n".join(rng.choice(pool[: 1 + i % 40]) + " " * rng.randint(0, 1) for _ in range(rng.randint(1, 6)))
        rows.append((i % 250 if i % 11 else None, text, f"s{rng.randint(0, 11)}" if i % 7 else None))
    rows += [(900, None, "s1"), (901, "\n\n", "s1")]
    sites = defaultdict(set)
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            if line.strip(" ") and site is not None:
                sites[line.strip(" ")].add(site)
    want = []
    for ident, text, _ in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if len(sites.get(x.strip(" "), ())) < 6]
        want.append((ident, "\n".join(left), len(lines), len(lines) - len(left)))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, _line int")
    assert sorted_rows(remove_spread_lines(docs, 6).collect()) == sorted_rows(want)
    assert remove_spread_lines(awkward(spark)).count() == 9
    assert remove_spread_lines(docs.limit(0)).collect() == []


def test_hypergeometric_draws_follow_the_law():
    rng = np.random.default_rng(1)
    draws = [hypergeometric(rng, 7, 5, 6) for _ in range(20000)]
    from math import comb

    for k in range(1, 7):
        expected = comb(7, k) * comb(5, 6 - k) / comb(12, 6)
        assert abs(draws.count(k) / 20000 - expected) < 0.012
    big = [hypergeometric(rng, 10**11, 7 * 10**11, 10**7) for _ in range(50)]
    assert abs(np.mean(big) - 1.25e6) < 2000


def test_matrix_keeps_both_margins():
    sizes = [0, 5, 1000, 17, 3]
    matrix = np.array(communication_matrix(sizes, 8, 3))
    assert matrix.sum(1).tolist() == sizes and (matrix >= 0).all()
    assert matrix.sum(0).max() - matrix.sum(0).min() <= 1


@pytest.mark.parametrize("n", [0, 1, 5, 1003])
def test_shards_are_even_and_gapless(spark, n):
    rows = [(i % 900 if i % 5 else None, "é" * (i % 9) if i % 4 else None, 1) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _uid int").repartition(6)
    got = shuffle_into_shards(docs, 8).collect()
    want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows]
    assert sorted_rows((r.doc_id, r["size"], r.text_crc32) for r in got) == sorted_rows(want)
    counts = Counter(r.shard for r in got)
    assert max(counts.values(), default=0) - min((counts.get(s, 0) for s in range(8)), default=0) <= 1
    for s, c in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(c))


def test_shuffle_is_spread_over_shards(spark):
    docs = spark.range(8000).selectExpr("id AS doc_id", "'t' AS text").repartitionByRange(4, "doc_id")
    got = shuffle_into_shards(docs, 8).collect()
    cells = Counter((r.doc_id // 2000, r.shard) for r in got)
    assert all(abs(cells[p, s] - 250) < 75 for p in range(4) for s in range(8))
    first = [r.doc_id for r in sorted((r for r in got if r.shard == 0), key=lambda r: r.slot)[:500]]
    assert abs(np.mean(first) - 4000) < 400


def naive_print(text):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(prints, radius=4):
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_fingerprint_by_definition():
    rng = random.Random(6)
    for n in (0, 1, 3, 4, 5, 200):
        text = " \t\x0b".join(rng.choice(["Ab", "É", "c", "d\xa0e"]) for _ in range(n))
        assert fingerprint(text.encode()) == naive_print(text)


def clustered(seed, n):
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n // 10)]
    while len(out) < n:
        out.append(rng.choice(out) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    return list(dict.fromkeys(out))


def test_tree_finds_all_pairs():
    prints = np.array(clustered(1, 900), np.uint64)
    found = set()
    for a, b in VantageTree(prints).matches(4):
        found |= set(zip(a.tolist(), b.tolist(), strict=True))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    assert found == set(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True))
    x, y = spanning_links(prints, 4)
    assert len(x) < len(prints) and (np.bitwise_count(x ^ y) >= 1).all()


@pytest.mark.parametrize("hot, shard", [(1 << 15, 256), (6, 256), (1 << 15, 1)])
def test_links_connect_what_brute_force_does(spark, monkeypatch, hot, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    values = clustered(2, 500)
    signed = [(v - (1 << 64) if v >= 1 << 63 else v,) for v in values]
    found = links(spark.createDataFrame(signed, "_fp long"), 4, hot)
    root = {r.v: r.root for r in components(found).collect()}
    want = naive_components(values)
    got = [root.get(s[0], s[0]) for s in signed]
    assert len(set(want)) == len(set(got)) == len(set(zip(want, got, strict=True)))


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5)]
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(301)}) == 1 and got[1000] == got[1001] != got[0]
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def simhash_fixture(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(300)] for _ in range(12)]
    rows = []
    for i in range(60):
        text = list(base[i % 12])
        for _ in range(i // 24):
            text[rng.randrange(300)] = "changed"
        rows.append((i * 3 % 61, " ".join(text).title()))
    rows += [(100, None), (101, ""), (102, "two words"), (None, "two words")]
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _fp int").repartition(4)


def test_simhash_components_by_brute_force(spark):
    docs = simhash_fixture(spark)
    rows = docs.collect()
    prints = [naive_print(r.text) for r in rows]
    root = naive_components(prints)
    low = {}
    for r, c in zip(rows, root, strict=True):
        ids = [x for x in (low.get(c), r.doc_id) if x is not None]
        low[c] = min(ids, default=None)
    want = [(r.doc_id, f"{p:016x}", low[c]) for r, p, c in zip(rows, prints, root, strict=True)]
    assert sorted_rows(simhash_components(docs).collect()) == sorted_rows(want)
    kept = keep_one_of_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(low.values()))
    assert simhash_components(docs.limit(0)).collect() == []
    assert simhash_components(awkward(spark)).count() == 9


def test_packing_is_valid_and_tight():
    rng = random.Random(9)
    pieces = sorted((rng.randint(1, 8192) for _ in range(3000)), reverse=True)
    bins, offsets, final = pack(pieces, LENGTHS, 64)
    fill = Counter()
    for p, b, o in zip(pieces, bins, offsets, strict=True):
        assert o == fill[b]
        fill[b] += p
    assert all(fill[b] <= final[b] and final[b] in LENGTHS for b in fill)
    assert all(not any(fill[b] <= s < final[b] for s in LENGTHS) for b in fill)
    assert sum(pieces) > 0.97 * sum(final)
    assert pack([], LENGTHS, 64) == ([], [], [])
    assert pack([10], LENGTHS, 64)[2] == [1024]


def test_pieces_cover_every_document(spark):
    docs = awkward(spark)
    got = pack_documents(docs).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1) for r in docs.collect())
    lengths = defaultdict(int)
    for r in got:
        lengths[r.doc_id] += r.length
        assert r.start == 8192 * r.piece and r.bin_offset + r.length <= r.bin_fill <= r.bin_length
    total = defaultdict(int)
    for (ident, n), times in want.items():
        total[ident] += n * times
    assert lengths == total
    spots = [(r.bin_group, r["bin"], r.bin_offset) for r in got]
    assert len(set(spots)) == len(spots)
    assert pack_documents(docs.limit(0)).collect() == []


def test_pipeline_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    last = {}
    for r in rows:
        last[folded(r.text)] = max(r.doc_id, last.get(folded(r.text), -1))
    exact = sorted(last.values())
    text = {r.doc_id: r.text for r in rows}
    near = set(naive_groups([(i, text[i]) for i in exact]).values())
    packed = corpus_pipeline.run(spark, SF)
    lengths = defaultdict(int)
    for r in packed.collect():
        lengths[r.doc_id] += r.length
    assert dict(lengths) == {i: len(text[i].encode()) + 1 for i in near}


def test_stages_on_awkward_rows(spark):
    docs = awkward(spark)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert stage(spark, docs.limit(0), SF).collect() == []
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns and out.count() <= docs.count()
