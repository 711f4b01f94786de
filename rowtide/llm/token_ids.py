"""Token ids of whole texts by the tokenizers library, remembered by word.

Where a tokenizer drops white space, the ids of a text are those of its words, one after
the other; so the library is asked once for each word that a worker has not met yet. If
it lower-cases and then cuts by the pattern below, texts of Latin letters are cut here, and
only the fragments, far fewer, are asked for, from the library's merge model. For any other
tokenizer whole texts are encoded.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
from tokenizers import Tokenizer

from rowtide.llm.bpe import byte_letters

# What lower-cases, and how it cuts.
NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# The same on lower-cased text up to U+017F (without U+0130, which becomes two characters) and
# of dashes and quotation marks; normalising leaves such text as it is.
_LETTER, _DIGIT, _SPACE = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_SPACE}{_LETTER}{_DIGIT}]+")
_OTHER = re.compile("[^\x00-\u012f\u0131-\u017f\u2010-\u2027]")
# Words and fragments remembered by a worker (as many again from before), and the longest of them.
REMEMBER = 300_000
LONGEST = 16


class _Known(dict):
    """Ids as bytes by fragment; what is not known is looked up, and remembered if it is short.

    When it is full it begins anew, and takes over what is asked for again.
    """

    def __init__(self, find):
        self.find, self.before = find, {}

    def __missing__(self, key: str) -> bytes:
        found = self.before.get(key)
        if found is None:
            found = self.find(key)
        if len(key) <= LONGEST:
            if len(self) >= REMEMBER:
                self.before = dict(self)
                self.clear()
            self[key] = found
        return found


class Encoder:
    """Ids without added tokens, truncation or padding."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        probe = ["a", "b", "a b", "a\n\n b", " a b "]
        a, b, *both = (e.ids for e in self.tokenizer.encode_batch(probe, add_special_tokens=False))
        self.by_word = all(ids == a + b for ids in both) and not any(len(t.split()) > 1 for t in self.added)
        spec = json.loads(self.tokenizer.to_str())
        cut = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.by_fragment = (
            self.by_word
            and (spec["normalizer"] or {}).get("normalizers") == NORMALIZERS
            and cut[0].get("pattern") == {"Regex": PATTERN}
            and [c["type"] for c in cut] == ["Split", "ByteLevel"]
        )
        # the model is asked in the letters that stand for bytes
        self.letters = byte_letters()
        self.model = self.tokenizer.model
        self.code = self.kind.char
        self.words, self.fragments = _Known(self._word), _Known(self._fragment)

    def _word(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _fragment(self, text: str) -> bytes:
        letters = self.letters
        spelled = "".join([letters[b] for b in text.encode()])
        return array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _cut(self, text: str) -> bytes | None:
        """Ids of a text that can be cut here."""
        if not self.by_fragment or _OTHER.search(text) or any(t in text for t in self.added):
            return None
        return b"".join(map(self.fragments.__getitem__, _CUT.findall(text.lower())))

    def _text(self, text: str) -> bytes:
        if not self.by_word:
            return self._word(text)
        whole = self._cut(text)
        if whole is not None:
            return whole
        parts = []
        for word in text.replace("\n", " ").split(" "):
            if word:
                found = self._cut(word)
                parts.append(self.words[word] if found is None else found)
        return b"".join(parts)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as numbers of ``kind``."""
        return [np.frombuffer(self._text(t), self.kind) for t in texts]
