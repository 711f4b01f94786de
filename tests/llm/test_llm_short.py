"""Fingerprints of short texts."""

from __future__ import annotations

import random

from rowtide.llm.winnowing import likeness, winnow


def test_short_texts_keep_part_of_an_edited_half():
    rng = random.Random(7)
    for n in range(20, 101):
        text, after = ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for _ in range(2))
        edited = text[: n - n // 2] + after[: n // 2]
        assert 0 < likeness(winnow(text)[0], winnow(edited)[0]) < 1
