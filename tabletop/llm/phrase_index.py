"""Exact phrases and proximity matches of test items in a corpus, by a positional inverted index.

The index stores every word of every text. Each task cuts its rows into segments of bounded size; a segment has one line of
word positions for all of its texts, with gaps between them, and one row for each of its terms: the positions as
increasing gaps. Rows of a segment lie in term order, so that files can be pruned by term. A segment also has a row with its
texts: id, first position, number of words. The index is written once and is independent of what is searched for.

A search looks for the windows of all items: runs of ``width`` words, or a shorter item as a whole. The corpus count of
each term follows from the index; a window is looked for only in segments that hold its rarest term. There the lists are
intersected from the rarest term on, each moved by its place in the window: what remains are starts at which every term is
found at its place (an exact phrase) or at most ``slack`` words from it (a proximity match). Matches in a text are joined into
stretches. Items are dealt to parts of bounded size, so a task holds the lists of one segment that one part needs, whatever
the sizes of corpus and items are; the join that brings them together is an equality on segment and part.

Defined results: A-Z are lower-cased; words are runs of digits, letters and all characters beyond ASCII. Null and empty texts have
no words. Items without words have no windows. Every row of the corpus is answered on its own, also repeated ones and those
with a null id. Items with the same id count as one; a null id counts as the empty text. Texts are read whole; a text that is larger than
a segment is one of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabletop.llm.common import portions, stored

WIDTH = 10
SLACK = 2
SEGMENT_CHARS = 8_000_000
PART_WORDS = 50_000
#: Positions between two texts that hold no word; a proximity match cannot cross them.
GAP = 64

_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_TABLE = bytes(byte if byte in _WORD else 32 for byte in bytes(range(256)).lower())
_INDEX = "segment bigint, term binary, n bigint, gaps array<int>, texts array<struct<doc_id: bigint, first: bigint, words: bigint>>"


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8."""
    return (text or b"").translate(_TABLE).split()


def _segment(number: int, ids: pa.Array, texts: list[bytes | None]) -> pa.RecordBatch:
    each = [words_of(text) for text in texts]
    counts = np.array([len(words) for words in each], np.int64)
    first = np.cumsum(counts + GAP) - counts - GAP
    coded = pa.array([word for words in each for word in words], pa.binary()).dictionary_encode()
    # Terms in order, and in each of them positions in order.
    sorted_ = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(sorted_), np.int64)
    place[sorted_] = np.arange(len(sorted_))
    term = place[coded.indices.to_numpy()]
    order = np.argsort(term, kind="stable")
    position = (np.arange(len(term)) + np.repeat(first - (np.cumsum(counts) - counts), counts))[order]
    n = np.bincount(term, minlength=len(sorted_))
    ends = np.cumsum(n)
    gaps = np.diff(position, prepend=0)
    starts = ends - n
    gaps[starts] = position[starts]
    total = len(n) + 1
    listed = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], ends, ends[-1:] if len(n) else [0]]), pa.int32()), pa.array(gaps, pa.int32()))
    facts = pa.StructArray.from_arrays(
        [ids, pa.array(first, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "first", "words"])
    held = pa.ListArray.from_arrays(pa.array([0] * total + [len(ids)], pa.int32()), facts)
    return pa.RecordBatch.from_arrays(
        [pa.array([number] * total, pa.int64()), pa.concat_arrays([coded.dictionary.take(pa.array(sorted_)), pa.array([None], pa.binary())]),
         pa.array(np.concatenate([n, [0]]), pa.int64()), listed, held], ["segment", "term", "n", "gaps", "texts"])


def build(docs: DataFrame, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """The index of ``docs`` (``doc_id``, ``text``): a row for each term of each segment, and one without a term."""
    def index(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for frame in frames:
            texts = frame.column("text").cast(pa.binary()).to_pylist()
            for start, end in portions(texts, segment_chars):
                yield _segment(number, frame.column("doc_id").slice(start, end - start), texts[start:end])
                number += 1

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(index, _INDEX)


def texts_of(index: DataFrame) -> DataFrame:
    """``segment``, ``place``, ``doc_id`` and ``n_words`` of all texts; the first two tell rows apart."""
    rows = index.where("term is null").select("segment", F.posexplode("texts").alias("place", "text"))
    return rows.select("segment", "place", "text.doc_id", F.col("text.words").alias("n_words"))


def _item_terms(items: DataFrame) -> DataFrame:
    """``item`` (the id as text) and ``terms`` of every different item with words, numbered."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda word: word != "")
    terms = F.transform(words, lambda word: word.cast("binary"))
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), terms.alias("terms"))
    return rows.where(F.size("terms") > 0).distinct().withColumn("no", F.monotonically_increasing_id())


def window_starts(lists: list[np.ndarray], terms: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of exact and of proximity matches of a window whose ``terms`` all occur, each with a list of positions."""
    order = np.argsort([len(lists[term]) for term in terms], kind="stable")

    def intersected(starts: np.ndarray, slack: int) -> np.ndarray:
        for step in order:
            if not len(starts):
                break
            found = lists[terms[step]]
            first = np.searchsorted(found, starts + (step - slack))
            starts = starts[np.abs(found[np.minimum(first, len(found) - 1)] - starts - step) <= slack]
        return starts

    rarest = lists[terms[order[0]]] - order[0]
    if not slack:
        rarest = intersected(rarest, 0)
        return rarest, rarest
    near = intersected(np.unique(rarest[:, None] + np.arange(-slack, slack + 1)), slack)
    return intersected(near, 0), near


def _stretches(starts: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what windows of ``width`` from ``starts`` cover, overlapping and adjacent ones joined."""
    every = np.unique(np.concatenate(starts)) if starts else np.zeros(0, np.int64)
    first = np.concatenate([[True], every[1:] > every[:-1] + width])[:len(every)]
    return every[first], every[np.concatenate([first[1:], [True]])[:len(every)]] + width


def _match(wanted: pa.Table, held: pa.Table, width: int, slack: int) -> pa.Table:
    """Matches of items in one segment, whose lists are ``held``."""
    numbers: dict[bytes, int] = {}
    lists: list[np.ndarray] = []
    texts: list[dict] = []
    for term, gaps, facts in zip(held.column("term"), held.column("gaps"), held.column("texts")):
        if term.is_valid:
            numbers[term.as_py()] = len(lists)
            lists.append(np.cumsum(gaps.values.to_numpy(), dtype=np.int64))
        else:
            texts = facts.as_py()
    first = np.array([text["first"] for text in texts], np.int64)
    words = np.array([text["words"] for text in texts], np.int64)
    columns: list[list] = [[], [], [], [], []]
    for item, terms in zip(wanted.column("item").to_pylist(), wanted.column("terms")):
        code = np.array([numbers.get(term, -1) for term in terms.as_py()])
        span = min(width, len(code))
        windows = np.lib.stride_tricks.sliding_window_view(code, span)
        exact, near = [], []
        for window in np.unique(windows[(windows >= 0).all(axis=1)], axis=0):
            both = window_starts(lists, window, slack)
            exact.append(both[0])
            near.append(both[1])
        for is_near, found in ((False, exact), (True, near)):
            start, end = _stretches(found, span)
            # A proximity match may begin some words before its text.
            text = np.maximum(np.searchsorted(first, start + (slack if is_near else 0), side="right") - 1, 0)
            start, end = np.maximum(start - first[text], 0), np.minimum(end - first[text], words[text])
            for column, values in zip(columns, (text, [item] * len(text), [is_near] * len(text), start, end)):
                column.extend(values)
    segment = wanted.column("segment")[0]
    types = (pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.int64())
    return pa.table([pa.array([segment.as_py()] * len(columns[0]), pa.int64()), *map(pa.array, columns, types)],
                    ["segment", "place", "item", "near", "start", "end"])


def matches(index: DataFrame, items: DataFrame, width: int = WIDTH, slack: int = SLACK, part_words: int = PART_WORDS) -> DataFrame:
    """Where windows of ``items`` (``item_id``, ``text``) stand in the texts of a stored ``index``.

    ``segment`` and ``place`` of the text, ``item``, ``near`` (false: exact phrases, true: proximity matches, of which exact ones are
    some), and the words from ``start`` to before ``end`` that a stretch of matches takes. ``slack`` is below half of the gap.
    """
    if not 0 <= 2 * slack + 1 < GAP:
        raise ValueError(f"slack is at most {GAP // 2 - 1}")
    wanted = stored(_item_terms(items), "items")
    parts = max(1, -(-(wanted.agg(F.sum(F.size("terms"))).first()[0] or 0) // part_words))
    wanted = wanted.withColumn("part", F.pmod(F.xxhash64("no"), F.lit(parts)))
    listed = wanted.select("no", "part", F.size("terms").alias("size"), F.posexplode("terms").alias("at", "term"))
    part_terms = stored(listed.select("part", "term").distinct(), "terms")
    lists = stored(index.where("term is not null").drop("texts").join(part_terms.select("term").distinct(), "term"), "lists")
    # The rarest term of every window, of which all terms occur somewhere.
    counts = lists.groupBy("term").agg(F.sum("n").alias("n"))
    ahead = Window.partitionBy("no").orderBy("at").rowsBetween(0, width - 1)
    span = F.least("size", F.lit(width))
    rarest = listed.join(counts, "term", "left").select(
        "no", "part", (F.count("n").over(ahead) == span).alias("whole"),
        F.min(F.when(F.col("n").isNotNull(), F.struct("n", "term"))).over(ahead)["term"].alias("term"))
    rarest = rarest.where("whole").select("no", "part", "term").distinct()
    asked = lists.select("segment", "term").join(rarest, "term").select("segment", "part", "no").distinct()
    asked = stored(asked, "asked")
    pairs = asked.select("segment", "part").distinct()
    terms = lists.select("segment", "term", "gaps", F.lit(None).cast(index.schema["texts"].dataType).alias("texts"))
    held = terms.join(part_terms, "term").join(pairs, ["segment", "part"], "left_semi").unionByName(
        index.where("term is null").select("segment", "term", "gaps", "texts").join(pairs, "segment"))
    asked = asked.join(wanted.select("no", "item", "terms"), "no")
    schema = "segment bigint, place int, item string, near boolean, start bigint, end bigint"
    return asked.groupBy("segment", "part").cogroup(held.groupBy("segment", "part")).applyInArrow(
        lambda some, lists: _match(some, lists, width, slack), schema)


def covered(found: DataFrame) -> DataFrame:
    """``segment``, ``place`` and ``n_hit``, the number of words in any of the stretches."""
    before = Window.partitionBy("segment", "place").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    return found.select("segment", "place", new.alias("new")).groupBy("segment", "place").agg(F.sum("new").alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, slack: int = SLACK,
                  segment_chars: int = SEGMENT_CHARS, part_words: int = PART_WORDS) -> DataFrame:
    """One row a document: ``doc_id``, ``n_words``, ``n_hit`` (words in exact matches), ``items`` and ``near_items`` (sorted ids as text)."""
    index = stored(build(docs, segment_chars), "index")
    found = stored(matches(index, items, width, slack, part_words), "matches")
    hit = covered(found.where("not near"))
    names = found.groupBy("segment", "place").agg(
        F.array_sort(F.collect_set(F.when(~F.col("near"), F.col("item")))).alias("items"),
        F.array_sort(F.collect_set(F.when(F.col("near"), F.col("item")))).alias("near_items"))
    rows = texts_of(index).join(names, ["segment", "place"], "left").join(hit, ["segment", "place"], "left")
    none = F.expr("cast(array() as array<string>)")
    return rows.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
                       F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"))
