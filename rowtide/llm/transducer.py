"""Token counts by a finite-state transducer compiled from BPE merges.

Reading a word, the transducer knows after each symbol which token the word so far would
end with. That is enough to go on: a token can end the word read so far exactly if it is
compatible with the last token of what stands before it, that is, if the two alone are
encoded as the two. Which symbols can still become part of a token is bounded by the
longest suffix that begins some token. A state is that suffix, with the last token and
the relative number of tokens at each of its borders; equal states are one state, so the
machine is finite and deterministic. A transition is annotated with the number of tokens
it emits (it may take some back). States and transitions are compiled when first met.

A text is cut into chunks of bounded size. White space resets the machine, so a chunk's
state map is a head (what comes before its first white space), the number emitted between,
and a tail; a chunk without white space only maps a state further. Such maps compose
associatively; a parallel prefix scan puts the chunks of a text together.

Defined results: a null text is an empty one with no tokens; strings of added tokens in a
text count as one token each, as the library has it by default; texts of any length are
read whole; every row is answered; other columns are not looked at.
"""

from __future__ import annotations

import json
import re
import unicodedata
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.llm.bpe import byte_letters
from rowtide.llm.common import bounded_batches, per_process, quoted, whole

# Fixed value: the words of a vocabulary with word ends.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Characters of a chunk; states and fragments remembered; tokens from which a text is over.
CHUNK = 1 << 16
STATES = 200_000
REMEMBER = 400_000
LIMIT = 2048

_START = ((), (-1,), (0,))


class WordTransducer:
    """Counts the tokens of words of bytes; the last byte of a word is a symbol of its own."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        of_letter = {c: b for b, c in enumerate(byte_letters())}
        self.ends = bool(suffix)

        def symbols(token: str) -> tuple[int, ...]:
            last = token.endswith(suffix) if suffix else False
            letters = token[: -len(suffix)] if last else token
            out = [of_letter[c] for c in letters]
            if last:
                out[-1] += 256
            return tuple(out)

        self.tokens: dict[tuple[int, ...], int] = {symbols(t): i for t, i in vocab.items()}
        self.spelled = {i: s for s, i in self.tokens.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a], vocab[b]] = (r, vocab[a + b])
            self.made[vocab[a + b]] = (r, vocab[a], vocab[b])
        self.begins = {s[:n] for s in self.tokens for n in range(1, len(s))}
        self.single = {s[0]: i for s, i in self.tokens.items() if len(s) == 1}
        self._alone: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states = [_START]
        self.number = {_START: 0}
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def merge(self, symbols: tuple[int, ...]) -> list[int]:
        """Token ids by the merge rules alone; used on pairs of tokens, when compiling."""
        ids = [self.single[s] for s in symbols]
        while len(ids) > 1:
            ranked = [(self.rank.get(p, (len(self.rank), 0)), i) for i, p in enumerate(zip(ids, ids[1:]))]
            (rank, made), i = min(ranked)
            if rank == len(self.rank):
                break
            ids[i : i + 2] = [made]
        return ids

    def _compatible(self, before: int, token: int) -> bool:
        known = self._alone.get((before, token))
        if known is None:
            if before < 0:
                known = self.merge(self.spelled[token]) == [token]
            else:
                known = self._stay_apart(before, token)
            self._alone[before, token] = known
        return known

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border while both tokens are put together.

        Both are taken apart again, the later merge first; at each step the two pieces
        at the border lie side by side until the merge that was just undone.
        """
        until = len(self.rank)
        while True:
            rank, _ = self.rank.get((a, b), (until, 0))
            if rank < until:
                return False
            made_a, made_b = self.made.get(a, (-1, a, a)), self.made.get(b, (-1, b, b))
            if made_a[0] < 0 and made_b[0] < 0:
                return True
            if made_a[0] > made_b[0]:
                until, a = made_a[0], made_a[2]
            else:  # of one rank the left pair merges first: before b's own merge, after a's
                until, b = made_b[0] + 1, made_b[1]

    def _compile(self, state: int, symbol: int) -> tuple[int, int]:
        context, lasts, counts = self.states[state]
        read = (*context, symbol)
        for cut in range(len(read)):
            token = self.tokens.get(read[cut:])
            if token is not None and self._compatible(lasts[cut], token):
                break
        else:
            raise ValueError("the vocabulary lacks a symbol")
        emitted = counts[cut] + 1
        if symbol >= 256:  # a word's last symbol
            return 0, emitted
        lasts, counts = (*lasts, token), (*counts, emitted)
        keep = 0
        while keep < len(read) and read[keep:] not in self.begins:
            keep += 1
        key = (read[keep:], lasts[keep:], tuple(c - emitted for c in counts[keep:]))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return self.number[key], emitted

    def count(self, word: bytes) -> int:
        """The tokens of one word."""
        if len(self.states) > STATES:
            self._reset()
        state = total = 0
        moves = self.moves
        last = len(word) - 1
        for i, symbol in enumerate(word):
            if i == last and self.ends:
                symbol += 256
            move = moves[state].get(symbol)
            if move is None:
                move = moves[state][symbol] = self._compile(state, symbol)
            state = move[0]
            total += move[1]
        return total


class Map(NamedTuple):
    """What a chunk does to the state: ``inner`` is None where no white space resets it."""

    head: str
    inner: int | None
    tail: str


class TokenCounter:
    """Counts tokens of texts; remembers a bounded number of fragments between white space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.machine = WordTransducer(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        names = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(map(re.escape, names))})") if names else None
        self.words = regex.compile(PATTERN)
        self.space = regex.compile(r"\s")
        self.separators = re.compile("[\x1c-\x1f]")
        self.known: dict[str, int] = {}

    def _words(self, fragment: str) -> int:
        folded = unicodedata.normalize("NFC", fragment).replace("Σ", "σ").lower()
        return sum(self.machine.count(w.encode()) for w in self.words.findall(folded))

    def fragment(self, text: str) -> int:
        """Tokens of a text that no white space cuts."""
        if self.special is not None and "<" in text:
            pieces = self.special.split(text)
            return sum(1 if i % 2 else self._words(p) for i, p in enumerate(pieces))
        return self._words(text)

    def closed(self, text: str) -> int:
        """Tokens of a text whose ends are ends of words."""
        # str.split() also cuts at four separators that are no white space here
        fragments = self.space.split(text) if self.separators.search(text) else text.split()
        try:
            return sum(map(self.known.__getitem__, fragments))
        except KeyError:
            if len(self.known) > REMEMBER:
                self.known.clear()
            for f in fragments:
                if f not in self.known:
                    self.known[f] = self.fragment(f)
            return sum(map(self.known.__getitem__, fragments))

    def chunk(self, text: str) -> Map:
        first = self.space.search(text)
        if first is None:
            return Map(text, None, "")
        last = next(i for i in range(len(text) - 1, -1, -1) if self.space.match(text[i]))
        return Map(text[: first.start()], self.closed(text[first.end() : last]), text[last + 1 :])

    def compose(self, a: Map, b: Map) -> Map:
        if a.inner is None:
            return Map(a.head + b.head, b.inner, b.tail)
        if b.inner is None:
            return Map(a.head, a.inner, a.tail + b.head)
        return Map(a.head, a.inner + self.closed(a.tail + b.head) + b.inner, b.tail)

    def scan(self, maps: list[Map]) -> Map:
        """All maps composed, in rounds of neighbours."""
        while len(maps) > 1:
            maps = [
                self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i]
                for i in range(0, len(maps), 2)
            ]
        return maps[0]

    def count(self, text: str) -> int:
        if len(text) <= CHUNK:
            return self.closed(text)
        chunks = [self.chunk(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        total = self.scan(chunks)
        return self.closed(total.head) + (total.inner or 0) + self.closed(total.tail)


def count_tokens(
    docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id n_bytes n_tokens over_limit`` of every row."""
    bounded_batches(docs.sparkSession)

    def work(batches):
        counter = per_process(("counter", path), lambda: TokenCounter(path))
        for batch in batches:
            counts = [counter.count(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    text = whole(F.col(quoted(text_col)))
    slim = docs.select(
        F.col(quoted(id_col)).alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        text.alias("_text"),
    )
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(work, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
