"""Byte-level BPE encoding and decoding by an index of pair occurrences.

A task gathers texts up to a bounded size and cuts them into fragments, each with the
white space before it, that no token crosses. Fragments not met before are merged
together, all at once: every pair with a merge rule is indexed by its rank with all its
positions, active ranks are applied in ascending order, each to all its positions, and
the lists of the pairs next to a merge are updated. That is the same as merging text by
text, because a merge never gives a pair of a lower rank than its own in the same word
that would have been applied before.

Ids are decoded from the ids alone. Strings of added tokens inside a text are those
tokens, as the library has it by default.

Defined results: a null text is an empty one, with no ids; texts of any length are read
whole; every row is answered; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.llm.common import bounded_batches, gathered, per_process, quoted, whole

# Fixed value: how text is split before the merges of a byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Bytes of text worked on together, and fragments remembered between.
GATHER = 12 << 20
REMEMBER = 300_000

_SHIFT = 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = [], 256
    for b in range(256):
        if b in printable:
            letters.append(chr(b))
        else:
            letters.append(chr(extra))
            extra += 1
    return letters


class Merges:
    """Ids and ranked merges of a vocabulary file (JSON), and encoding of many words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.added: dict[str, int] = {}
        for token in spec["added_tokens"]:
            if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
                raise ValueError("added tokens with matching rules of their own are not supported")
            self.added[token["content"]] = token["id"]
        names = sorted(self.added, key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(map(re.escape, names))})") if names else None
        self.letters = byte_letters()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = np.array([[self.vocab[a], self.vocab[b], self.vocab[a + b]] for a, b in pairs])
        self.left, self.right, self.made = (ids[:, i].copy() for i in range(3))
        keys = (self.left << _SHIFT) | self.right
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it does not merge."""
        key = (left << _SHIFT) | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], -1)

    def encode(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as concatenated symbols; returns ids and their number per word."""
        n = len(symbols)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        sym = np.append(symbols.astype(np.int64), -2)
        after = np.arange(1, n + 2)
        after[ends[lengths > 0] - 1] = n
        before = np.arange(-1, n)
        before[starts[lengths > 0]] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            rank = self.ranks(sym[at], sym[after[at]])
            has = rank >= 0
            at, rank = at[has], rank[has]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, positions in zip(rank[np.append(0, cuts)].tolist(), np.split(at, cuts), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(positions)

        every = np.arange(n)
        add(every[after[:n] < n])
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = np.unique(np.concatenate(lists))
            left, right = int(self.left[rank]), int(self.right[rank])
            at = at[(sym[at] == left) & (sym[after[at]] == right)]
            if not len(at):
                continue
            if left == right:
                at = _apart(at, after)
            gone = after[at]
            far = after[gone]
            sym[at], sym[gone] = self.made[rank], -1
            after[at] = far
            inside = far < n
            before[far[inside]] = at[inside]
            ahead = before[at]
            add(np.concatenate([ahead[ahead >= 0], at[inside]]))
        alive = sym[:n] >= 0
        counts = np.add.reduceat(alive, starts[lengths > 0]) if alive.any() else np.zeros(0)
        per_word = np.zeros(len(lengths), np.int64)
        per_word[lengths > 0] = counts
        return sym[:n][alive], per_word


def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of overlapping pairs of one symbol, those that are merged from the left."""
    if not np.isin(after[at], at).any():
        return at
    chosen, taken = [], -1
    for p in at.tolist():
        if p != taken:
            chosen.append(p)
            taken = int(after[p])
        else:
            taken = -1
    return np.array(chosen)


class _Numbers(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


class ByteCodec:
    """Encodes and decodes texts; remembers the ids of a bounded number of fragments."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.pattern = regex.compile(PATTERN)
        self.odd_space = re.compile(r"\s ")
        vocab, letters = self.merges.vocab, self.merges.letters
        self.byte_ids = np.array([vocab[c] for c in letters])
        of_letter = {c: b for b, c in enumerate(letters)}
        size = max([*vocab.values(), *self.merges.added.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(map(of_letter.__getitem__, token))
        for token, i in self.merges.added.items():
            self.token_bytes[i] = token.encode()
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.done = 0
        self.ids: list[np.ndarray] = []
        self.flat, self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _fragments(self, text: str) -> list:
        """Keys of the fragments; a string stands for itself after one space, a tuple for itself."""
        if self.merges.special is not None:
            pieces = self.merges.special.split(text)
            if len(pieces) > 1:
                keys = []
                for i, piece in enumerate(pieces):
                    keys += [(piece, 1)] if i % 2 else self._plain(piece)
                return keys
        return self._plain(text)

    def _plain(self, text: str) -> list:
        if not text:
            return []
        if self.odd_space.search(text):
            return [(word,) for word in self.pattern.findall(text)]
        pieces = text.split(" ")
        pieces[0] = (pieces[0],)
        return pieces

    def _learn(self) -> None:
        """Merge the fragments numbered since the last call."""
        keys = list(self.numbers)[self.done :]
        if not keys:
            return
        words, owners = _Numbers(), []
        special: dict[int, int] = {}
        for i, key in enumerate(keys):
            if isinstance(key, tuple) and len(key) == 2:
                special[i] = self.merges.added[key[0]]
                owners.append([])
                continue
            text = key[0] if isinstance(key, tuple) else " " + key
            owners.append([words[w] for w in self.pattern.findall(text)])
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        ids, counts = self.merges.encode(symbols, lengths)
        ends = np.cumsum(counts)
        starts = ends - counts
        sizes = np.fromiter(map(len, owners), np.int64, len(owners))
        flat_owner = np.fromiter((w for o in owners for w in o), np.int64, int(sizes.sum()))
        flat = ids[_spans(starts[flat_owner], counts[flat_owner])]
        per_key = np.zeros(len(keys), np.int64)
        np.add.at(per_key, np.repeat(np.arange(len(keys)), sizes), counts[flat_owner])
        if special:
            where = np.array(list(special))
            per_key[where] = 1
            at = (np.cumsum(per_key) - per_key)[where]
            whole_flat = np.empty(int(per_key.sum()), np.int64)
            hole = np.zeros(len(whole_flat), bool)
            hole[at] = True
            whole_flat[hole], whole_flat[~hole] = list(special.values()), flat
            flat = whole_flat
        self.start = np.append(self.start, len(self.flat) + np.cumsum(per_key) - per_key)
        self.count = np.append(self.count, per_key)
        self.flat = np.append(self.flat, flat)
        self.done = len(self.numbers)

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        if len(self.numbers) > REMEMBER:
            self._forget()
        number = self.numbers.__getitem__
        numbered = []
        for text in texts:
            keys = self._fragments(text)
            numbered.append(np.fromiter(map(number, keys), np.int32, len(keys)))
        self._learn()
        for at in numbered:
            yield self.flat[_spans(self.start[at], self.count[at])]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; bytes that are no UTF-8 become replacement marks."""
        data = b"".join(map(self.token_bytes.__getitem__, ids.tolist()))
        return data.decode("utf-8", "replace").encode()


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - shift, counts)


def encode_texts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id ids``: the token ids of every text as an array."""
    return _with_codec(docs, path, id_col, text_col, _ids_columns, "ids array<int>")


def round_trip(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id n_tokens ids_sha256 decoded_sha256``: digests of ids and of what they decode to."""
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _with_codec(docs, path, id_col, text_col, _digest_columns, schema)


def _ids_columns(codec: ByteCodec, texts: list[str]) -> list[pa.Array]:
    return [pa.array((ids for ids in codec.encode_all(texts)), pa.list_(pa.int32()))]


def _digest_columns(codec: ByteCodec, texts: list[str]) -> list[pa.Array]:
    counts, first, second = [], [], []
    written = list(map(str, range(len(codec.token_bytes))))
    for ids in codec.encode_all(texts):
        counts.append(len(ids))
        joined = ",".join(map(written.__getitem__, ids.tolist()))
        first.append(hashlib.sha256(joined.encode()).hexdigest())
        second.append(hashlib.sha256(codec.decode(ids)).hexdigest())
    return [pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]


def _with_codec(docs, path, id_col, text_col, columns, schema) -> DataFrame:
    bounded_batches(docs.sparkSession)
    names = ["doc_id", *(c.split()[0] for c in schema.split(", "))]

    def work(batches):
        codec = per_process(("codec", path), lambda: ByteCodec(path))
        for batch in gathered(batches, GATHER):
            made = columns(codec, batch.column("_text").to_pylist())
            table = pa.table([batch.column("doc_id"), *made], names)
            yield from table.to_batches()

    slim = docs.select(
        F.col(quoted(id_col)).alias("doc_id"), whole(F.col(quoted(text_col))).alias("_text")
    )
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(work, f"doc_id {kind}, {schema}")


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id text`` from rows of token ids; a null array is an empty text."""
    bounded_batches(encoded.sparkSession)

    def work(batches):
        codec = per_process(("codec", path), lambda: ByteCodec(path))
        for batch in batches:
            texts = [
                codec.decode(np.array(ids or [], np.int64)).decode()
                for ids in batch.column("_ids").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    slim = encoded.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(ids_col)).alias("_ids"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(work, f"doc_id {kind}, text string")
