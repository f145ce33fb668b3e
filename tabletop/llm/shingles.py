"""Hashed runs of words of many texts at once, with numpy."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xBF58476D1CE4E5B9)
_RUN = np.uint64(0x94D049BB133111EB)
_SPACES = np.array([*range(9, 14), 32], np.uint32)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * _ODD
    values = (values ^ (values >> np.uint64(27))) * _RUN
    return values ^ (values >> np.uint64(31))


def word_hashes(texts: list[str | None], inner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text.

    Words end at blanks and the characters 9 to 13, or at all characters that ``inner``, a table by code, does not mark.
    """
    joined = [f"{text or ''} " for text in texts]
    codes = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(text) for text in joined])
    space = np.isin(codes, _SPACES) if inner is None else ~inner[codes]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    stops = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    solid = np.flatnonzero(~space)
    firsts = np.cumsum(stops - starts) - (stops - starts)
    place = np.arange(len(solid)) - np.repeat(firsts, stops - starts)
    powers = np.full(int((stops - starts).max()), _BASE)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    sums = np.add.reduceat((codes[solid].astype(np.uint64) + np.uint64(1)) * powers[place], firsts)
    return mixed(sums), counts


def shingle_hashes(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, repeats included, and how many each text has.

    A text of fewer words has one run, all its words; a text without words has none.
    """
    words, counts = word_hashes(texts)
    if not len(words):
        return words, counts
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    each = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    total = int(each.sum())
    owner = np.repeat(np.arange(len(counts)), each)
    start = np.arange(total) - np.repeat(np.cumsum(each) - each, each) + firsts[owner]
    length = np.minimum(counts, width)[owner]
    sums = np.zeros(total, np.uint64)
    for step in range(width):
        inside = step < length
        value = words[np.minimum(start + step, len(words) - 1)]
        sums = np.where(inside, sums * _RUN + value + np.uint64(1), sums)
    return mixed(sums), each
