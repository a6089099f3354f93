"""Texts as arrays of lower-cased letters, for the vectorised n-gram features."""

from __future__ import annotations

from functools import cache

import numpy as np


@cache
def letter_table() -> np.ndarray:
    """For each code point its lower-cased letter's code point (the first, where lower-casing gives more), or 0."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(len(out)):
        if (c := chr(i)).isalpha():
            out[i] = ord(c.lower()[0])
    return out


def letter_runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all texts, words set apart by one 0: before and after each text stands a 0, too. And the places
    where the texts' first 0s are, with the end."""
    codes = np.frombuffer("\n".join(["", *(x.replace("\n", " ") for x in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes_letter = letter_table()[codes]
    ends = codes == 10
    keep = codes_letter > 0
    keep[1:] |= codes_letter[:-1] > 0  # the first separator after a word
    keep |= ends
    # A text's end is the separator of its last word: drop another one right before it.
    kept = np.flatnonzero(keep)
    twice = np.zeros(len(kept), bool)
    zero, last = codes_letter[kept] == 0, ends[kept]
    twice[:-1] = zero[:-1] & ~last[:-1] & zero[1:]
    kept = kept[~twice]
    return codes_letter[kept], np.flatnonzero(ends[kept])


def text_blocks(texts: list[str], limit: int = 300_000) -> list[list[str]]:
    """Runs of texts of at most `limit` characters, or one longer text."""
    out: list[list[str]] = []
    size = limit + 1
    for x in texts:
        if size + len(x) > limit:
            out.append([])
            size = 0
        out[-1].append(x)
        size += len(x)
    return out
