"""Mixture packing against the tokenizer library and a literal round-robin."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_llm_text import SF, WORD, awkward, texts
from tokenizers import Tokenizer

from rowtide.llm.mixture import WINDOW, pack_mixture, packed_stream, token_packets, window_ends
from rowtide.llm.token_ids import Encoder


def test_ids_equal_library(spark):
    library = Tokenizer.from_file(WORD)
    given = texts()
    encoder = Encoder(WORD)
    assert encoder.by_word
    for _ in range(2):  # words unknown, then known
        for text, ids in zip(given, encoder.encode(given), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()
    whole = [r.text or "" for r in rows]
    for text, ids in zip(whole, encoder.encode(whole), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def check_cover(docs, pieces, window):
    """Every id in exactly one piece, sequences without gaps and full but for powers of two."""
    library = Tokenizer.from_file(WORD)
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
        want[r.doc_id, tuple(ids)] += 1
    parts, rows = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert p.ids_crc32 == zlib.crc32(p.ids) and len(ids) == p.length > 0
        rows[p.sequence_id].append((p.offset, p.length))
        parts[p.doc_id, p.start].append((p.length, p.doc_tokens, tuple(ids.tolist())))
    total = sum(len(ids) * n for (_, ids), n in want.items())
    assert sorted(rows) == list(range(len(rows)))
    for found in rows.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at == window or (at < window and at & (at - 1) == 0)
    assert sum(n for found in rows.values() for _, n in found) == total
    assert len(rows) == total // window + len(window_ends(total, window))
    return want, parts


def test_every_id_is_packed_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want, parts = check_cover(docs, pack_mixture(docs, WORD).collect(), WINDOW)
    for (doc, ids), _ in want.items():
        at = 0
        while at < len(ids):
            ((length, tokens, got),) = parts[doc, at]
            assert tokens == len(ids) and got == ids[at : at + length]
            at += length
        assert at == len(ids)


def round_robin(queues, quantum):
    """Packets in the order they are sent, with literal counters, one round after the other."""
    queues = {s: list(q) for s, q in queues.items()}
    counters = dict.fromkeys(queues, 0.0)
    sent, turn = [], 0
    while any(queues.values()):
        for s, queue in queues.items():
            counters[s] += quantum[s]
            while queue and counters[s] > 0:
                uid, length = queue.pop(0)
                counters[s] -= length
                sent.append((turn, uid))
        turn += 1
    return sent


@pytest.mark.parametrize("targets", [None, {"a": 2.0, None: 1.0, "c": 4.0}])
def test_rounds_equal_literal_counters(spark, targets):
    rng = random.Random(2)
    rows, queues = [], defaultdict(list)
    for uid in range(400):
        source = rng.choice(["a", "a", "a", "b", "c", None])
        length = rng.choice([1, 2, 5, 8, 16])
        rows.append((uid, uid, source, 0, length))
    for uid, _, source, _, length in rows:
        queues[source].append((uid, length))
    tokens = {s: sum(n for _, n in q) for s, q in queues.items()}
    weights = tokens if targets is None else {s: targets.get(s, 1.0) for s in queues}
    window = 16
    quantum = {s: weights[s] * (window / sum(weights.values())) for s in queues}
    order = sorted(queues, key=lambda s: (s is not None, s or ""))
    frame = spark.createDataFrame(rows, "_uid long, doc_id long, source string, start long, length long")
    got = packed_stream(frame.repartition(6), targets, window).orderBy("_pos").collect()
    want = round_robin({s: queues[s] for s in order}, quantum)
    assert [(r._round, r._uid) for r in got] == want
    at = 0
    for r in got:
        assert r._pos == at
        at += r.length
    if targets is None:  # every window end is near the targets, whatever came before
        served = dict.fromkeys(queues, 0)
        for r in got:
            served[rows[r._uid][2]] += r.length
            for s in queues:
                assert abs(served[s] - quantum[s] * (r._pos + r.length) / window) <= 16 + window


def test_long_documents_and_awkward_rows(spark):
    docs = awkward(spark)
    packets = token_packets(docs, WORD, longest=64)
    assert packets.agg({"length": "max"}).first()[0] == 64
    pieces = pack_mixture(docs, WORD, window=64).collect()
    check_cover(docs, pieces, 64)
    empty = pack_mixture(docs.limit(0), WORD)
    assert empty.collect() == []
    # rows that repeat the identifier are packed each
    assert sum(p.start == 0 and p.doc_id == 1 for p in pieces) == 2


def test_tail_is_cut_into_powers_of_two():
    assert window_ends(3 * 4096, 4096) == []
    assert window_ends(4096 + 1000, 4096) == [4608, 4864, 4992, 5056, 5088, 5096]
    assert window_ends(10, 7) == [9, 10]
