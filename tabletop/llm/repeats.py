"""Runs of words: stretches that repeat with a period, found in an enhanced suffix array.

The suffixes of every text are sorted by doubling: ranks of stretches of 1, 2, 4, ... words. From the ranks follow the suffix
array, its inverse (ISA) and the longest common prefixes (LCP) of neighbours. Each LCP value is a cut of an interval of the
array into two sides that share ``depth`` words and no more. The suffixes of the smaller side are tested: if ISA[i + depth] or
ISA[i - depth] lies in the other side, two equal stretches of ``depth`` words follow each other there and what comes after
them differs: a square at the right end of its run. Rotated to the left for as long as the words before its halves agree,
the square grows into the run; several squares of one run are merged. Every step is one numpy operation over all texts of a
portion, there are no tree nodes.

A run is a stretch of smallest period q and of length >= max(``least``, ``times`` * q) that cannot be extended to either side
with that period. A word is dropped if any run contains it after that run's first q words.

Defined results: words end at blanks and the characters 9 to 13 and are compared byte by byte. Null and empty texts have no
words, no runs, and collapse to the empty text. Texts are read whole; one text must fit into a task's memory (at most some
300 bytes a word). Every repeated row is answered, no rows give none, and other columns pass unless they are called like an
added one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletop.llm.common import batches

LEAST = 6
TIMES = 4
_PORTION = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def ranks(codes: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, ...: the ranks of the stretches of 2^k words from every place, until no two are equal.

    The rank of a stretch is the number of smaller ones. Owners follow each other; stretches cut off by their owner's end are unlike
    all others. Each array has one more entry, -1.
    """
    total = len(codes)
    key, tied = owner * (int(codes.max(initial=0)) + 1) + codes, np.arange(total)
    group = np.zeros(total, np.int64)
    level, levels, width = np.full(total + 1, -1), [], 1
    while True:
        order = np.argsort(key, kind="stable")
        tied, group, key = tied[order], group[order], key[order]
        at = np.arange(len(tied))
        head = np.concatenate([[True], group[1:] != group[:-1]])
        first = np.concatenate([[True], key[1:] != key[:-1]])
        new = group + np.maximum.accumulate(np.where(first, at, 0)) - np.maximum.accumulate(np.where(head, at, 0))
        level = level.copy()
        level[tied] = new
        levels.append(level)
        again = ~first
        again[:-1] |= ~first[1:]
        tied, group = tied[again], new[again]
        if not len(tied):
            return levels
        after = tied + width
        follow = np.where(after < ends[owner[tied]], level[np.minimum(after, total)], -1)
        key, width = group * (total + 1) + follow + 1, width * 2


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal words from ``a`` and ``b`` on, places of one owner."""
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 2, -1, -1):
        length += (levels[k][a + length] == levels[k][b + length]).astype(np.int64) << k
    return length


def _common_before(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Number of equal words before ``a`` and ``b``, from ``begin`` on."""
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 2, -1, -1):
        left = a - length - (1 << k)
        same = (left >= begin) & (levels[k][np.maximum(left, 0)] == levels[k][np.maximum(left + b - a, 0)])
        length += same.astype(np.int64) << k
    return length


def _limits(lcp: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each cut the nearest smaller value to the left, and the nearest to the right that is not larger."""
    left, right = np.arange(len(lcp)) - 1, np.arange(len(lcp)) + 1
    for side, passes in ((left, np.greater_equal), (right, np.greater)):
        open_ = cuts
        while len(open_):
            open_ = open_[passes(lcp[side[open_]], lcp[open_])]
            side[open_] = side[side[open_]]
    return left[cuts], right[cuts]


def squares(levels: list[np.ndarray], owner: np.ndarray, begins: np.ndarray, ends: np.ndarray,
            times: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and half lengths of all squares at the right ends of stretches that could have ``times`` periods."""
    inverse = levels[-1][:-1]
    total = len(inverse)
    array = np.empty(total, np.int64)
    array[inverse] = np.arange(total)
    lcp = np.zeros(total + 1, np.int64)
    beside = np.flatnonzero(owner[array[1:]] == owner[array[:-1]]) + 1
    lcp[beside] = _common(levels, array[beside - 1], array[beside])
    lcp[total] = -1
    cuts = np.flatnonzero(lcp > 0)
    left, right = _limits(lcp, cuts)
    depth = lcp[cuts]
    size = (ends - begins)[owner[array[cuts]]]
    open_ = depth * times <= size
    cuts, left, right, depth = cuts[open_], left[open_], right[open_], depth[open_]
    smaller = cuts - left <= right - cuts
    first = np.where(smaller, left, cuts)
    count = np.where(smaller, cuts - left, right - cuts)
    other, stop = np.where(smaller, cuts, left), np.where(smaller, right, cuts)
    cut = np.repeat(np.arange(len(cuts)), count)
    suffix = array[np.arange(len(cut)) - np.repeat(np.cumsum(count) - count - first, count)]
    step = depth[cut]
    starts, halves = [], []
    for place, start in ((suffix + step, suffix), (suffix - step, suffix - step)):
        inside = (place >= 0) & (place < total)
        rank = np.where(inside, inverse[np.where(inside, place, 0)], -1)
        found = (rank >= other[cut]) & (rank < stop[cut])
        starts.append(start[found])
        halves.append(step[found])
    return np.concatenate(starts), np.concatenate(halves)


def find_runs(codes: np.ndarray, counts: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (text, start, length, period), sorted, of the runs in texts of ``counts`` words with the numbers ``codes``."""
    owner = np.repeat(np.arange(len(counts)), counts)
    # A run with period q shares so many words with itself, q words later: a text without two such stretches has none.
    shared = min(max(least - q, (times - 1) * q) for q in range(1, least + 1))
    held = np.zeros(len(counts), bool)
    windows = len(codes) - shared + 1
    if windows > 0:
        key = np.zeros(windows, np.uint64)
        for step in range(shared):
            key = key * _BASE + codes[step:step + windows].astype(np.uint64) + np.uint64(1)
        whole = np.flatnonzero(owner[:windows] == owner[shared - 1:])
        key = (key[whole] ^ (owner[whole].astype(np.uint64) << np.uint64(40))) * _BASE
        order = np.argsort(key)
        held[owner[whole[order[1:][key[order[1:]] == key[order[:-1]]]]]] = True
    keep = held[owner]
    if not keep.any():
        return np.zeros((0, 4), np.int64)
    texts = np.flatnonzero(held)
    codes, sizes = codes[keep], counts[texts]
    owner = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    levels = ranks(codes, owner, ends)
    start, period = squares(levels, owner, begins, ends, times)
    grown = _common_before(levels, start, start + period, begins[owner[start]])
    start, length = start - grown, grown + 2 * period
    long = length >= np.maximum(least, times * period)
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    # The same stretch is also found with multiples of its smallest period.
    first = np.concatenate([[True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])])[:len(start)]
    start, length, period = start[first], length[first], period[first]
    text = owner[start]
    found = np.column_stack([texts[text], start - begins[text], length, period])
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def texts_with_runs(texts: list[bytes | None], least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Number of words of each text, the runs as of ``find_runs``, and the collapsed texts."""
    words = [(text or b"").split() for text in texts]
    counts = np.array([len(some) for some in words], np.int64)
    numbered = pa.array([word for some in words for word in some], pa.binary()).dictionary_encode()
    found = find_runs(numbered.indices.to_numpy().astype(np.int64), counts, least, times)
    for i in np.unique(found[:, 0]):
        depth = np.zeros(counts[i] + 1, np.int64)
        for _, start, length, period in found[found[:, 0] == i]:
            depth[start + period] += 1
            depth[start + length] -= 1
        words[i] = [words[i][k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
    return counts, found, [b" ".join(some) for some in words]


def collapse(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (``start``, ``length``, ``period``; by start, then period) and ``collapsed`` text.

    Every other column passes, ``text`` only if asked for. One pass over the rows, no shuffle.
    """
    docs = docs.drop("n_words", "runs", "collapsed")
    names = [name for name in docs.columns if keep_text or name != text]
    schema = docs.select(*names, F.lit(0).cast("bigint").alias("n_words"), F.expr(
        "cast(array() as array<struct<start bigint, length bigint, period bigint>>)").alias("runs"), F.lit("").alias("collapsed")).schema

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames, text, _PORTION):
            counts, found, kept = texts_with_runs(frame.column(text).cast(pa.binary()).to_pylist(), least, times)
            ends = np.searchsorted(found[:, 0], np.arange(len(counts) + 1))
            parts = [pa.array(found[:, column], pa.int64()) for column in (1, 2, 3)]
            runs = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
            more = [pa.array(counts, pa.int64()), runs, pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*[frame.column(name) for name in names], *more], schema.names)

    return docs.mapInArrow(run, schema)
