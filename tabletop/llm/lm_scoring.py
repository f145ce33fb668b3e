"""Scores of documents by masked pseudo-likelihood under a bidirectional window network.

Every word is predicted from the words on both sides of it, in two levels. The network (embeddings of the window, one
hidden layer) predicts a class of words by a softmax and the word in its class by a binary tree, at each node of which the
hidden layer says how likely each branch is. Frequent words are dealt to classes of about equal mass. All others stand in
the tree as buckets of their endings; in its bucket each word has its exact share of the corpus, for which scores are joined
with the counts of all words. A bucket counts one word more than it has, which is what words not met in training share.

Counts of all words of the corpus are summed by Spark. Training runs in rounds: every task starts from the same weights,
learns from the positions of every document in its rows (each ``stride``-th, another phase each round, so that after
``stride`` rounds every position of the corpus was a target once) by stochastic gradient steps in numpy, and the weights of
all tasks are averaged by Spark, by the number of positions, in two levels of groups. Small partitions are put together
before, so that a task takes many steps from the weights it starts with. So what is gathered from the corpus, counts and weights,
grows with it, while the driver only holds the frequent words, the counts of as many others as ``_KNOWN`` says and one set of
weights, all of fixed size; counts of the other words stay in files and are joined.

Words are numbered once, after counting: all rounds and the scores read the numbers of a text from files. The steps of all ways
are put one depth after the other, so that the words that still go down at a depth are the first ones of a step.

Defined results: words are lower-cased and end at white space. Null and empty texts have no words, a log-probability of 0
and a mean of 0. Texts are read whole. Repeated rows count and are scored each. No rows give no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletop.llm.common import batches, portions, stored

VOCABULARY = 8192
CLASSES = 64
ENDINGS = 1024
ENDING_CLASSES = 16
SIDE = 2
EMBEDDING = 8
HIDDEN = 32
_COUNTED_WORDS = 300_000
_COUNTED_CHARS = 5_000_000
_KNOWN = 131_072
_PORTION = 1_000_000
_SCORED = 2048
_AROUND = np.array([step for step in range(-SIDE, SIDE + 1) if step])
_BLOCK = 8192
_STEP = 128
_LARGEST_STEP = 512
_FAN_IN = 32
_TASK_WORDS = 500_000
ROUNDS = 2


def ending(word: str) -> int:
    """Bucket of a word that is not frequent."""
    return zlib.crc32(word[-3:].encode("utf-8", "surrogatepass")) % ENDINGS


@dataclass(frozen=True)
class WindowModel:
    """``ids`` of frequent words, ``word_class`` by id, the trees of the classes, and the network's weights.

    Ids: endings first, then frequent words, then the mark for what lies beyond the ends of a text. The way to an id in the
    tree of its class takes ``lengths`` steps from ``starts`` in ``nodes`` and ``signs`` (1 for the first branch). ``log_share``
    is that of a word met once in the bucket of an ending, and 0 for frequent words. Of the others, ``known`` has the counts of the
    commonest and ``rest`` those of all that are left but of words met once, which add nothing.
    """

    ids: dict[str, int]
    word_class: np.ndarray
    log_share: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    nodes: np.ndarray
    signs: np.ndarray
    weights: np.ndarray
    rest: DataFrame | None = None
    known: dict[str, int] = field(default_factory=dict)

    def shapes(self) -> list[tuple[int, ...]]:
        outputs = int(self.word_class.max()) + 1
        branches = int(self.nodes.max()) + 1
        return [(len(self.word_class) + 1, EMBEDDING), (2 * SIDE * EMBEDDING, HIDDEN), (HIDDEN,), (HIDDEN, outputs), (outputs,),
                (branches, HIDDEN), (branches,)]

    def layers(self, weights: np.ndarray) -> list[np.ndarray]:
        """Views of one flat array."""
        found, start = [], 0
        for shape in self.shapes():
            size = int(np.prod(shape))
            found.append(weights[start:start + size].reshape(shape))
            start += size
        return found

    def longest_first(self, ids: np.ndarray) -> np.ndarray:
        return np.argsort(-self.lengths.take(ids), kind="stable")

    def ways(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Steps through the trees to all of ``ids``: place in ``ids``, node and sign; the first steps of all, the second and so on,
        the longest ways first."""
        order = self.longest_first(ids)
        starts, lengths = self.starts.take(ids).take(order), self.lengths.take(ids).take(order)
        held = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0, dtype=lengths.dtype)).tolist()
        none = np.zeros(0, np.int64)
        place = np.concatenate([none, *(order[:n] for n in held)])
        step = np.concatenate([none, *(starts[:n] + depth for depth, n in enumerate(held))])
        return place, self.nodes.take(step), self.signs.take(step)


def _words(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, one after the other, and how many each text has."""
    counts, joined = np.zeros(len(texts), np.int64), []
    for i, value in enumerate(texts):
        words = (value or "").lower().split()
        if words:
            counts[i] = len(words)
            joined.append(" ".join(words))
    return pc.split_pattern(pa.array(joined, pa.string()), " ").flatten(), counts


def _numbers(words: pa.Array, listed: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Numbers of all words: that of their ending, or ``ENDINGS`` and their place among those ``listed``; where they stand among the
    different words, and these."""
    coded = words.dictionary_encode()
    place = coded.indices.to_numpy(zero_copy_only=False)
    ends = pc.utf8_slice_codeunits(coded.dictionary, -3).dictionary_encode()
    bucket = np.array([ending(end) for end in ends.dictionary.to_pylist()], np.int64)
    bucket = bucket.take(ends.indices.to_numpy(zero_copy_only=False)) if len(ends) else np.zeros(0, np.int64)
    own = pc.fill_null(pc.index_in(coded.dictionary, value_set=listed), -1).to_numpy(zero_copy_only=False)
    return np.where(own >= 0, ENDINGS + own, bucket).take(place) if len(place) else np.zeros(0, np.int64), coded.dictionary, place


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word``, its ``ending`` and count ``n`` over all documents; every task sums up before the shuffle."""
    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(parts: list[pa.Table]) -> pa.Table:
            both = pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")])
            return both.select(["word", "n_sum"]).rename_columns(["word", "n"])

        parts, held = [], 0
        for frame in batches(frames, text, _COUNTED_CHARS):
            met = _words(frame.column(text).to_pylist())[0].value_counts()
            parts.append(pa.table({"word": met.field("values"), "n": met.field("counts")}))
            held += len(met)
            if held > 2 * _COUNTED_WORDS:
                parts = [summed(parts)]
                held = len(parts[0])
                if held > _COUNTED_WORDS:
                    yield from parts[0].to_batches()
                    parts, held = [], 0
        if parts:
            yield from summed(parts).to_batches()

    counted = docs.select(text).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    bucket = F.crc32(F.right("word", F.lit(3)).cast("binary")) % ENDINGS
    return counted.select("word", bucket.cast("int").alias("ending"), "n")


def _trees(word_class: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A Huffman tree for each class: starts, lengths, nodes and signs of the ways to all ids, and the log-odds of nodes."""
    ways: list[list[tuple[int, int]]] = [[] for _ in n]
    odds: list[float] = []
    for group in range(int(word_class.max()) + 1):
        heap = [(float(n[i]), int(i), [int(i)]) for i in np.flatnonzero(word_class == group)]
        heapq.heapify(heap)
        while len(heap) > 1:
            (low, _, right), (high, first, left) = heapq.heappop(heap), heapq.heappop(heap)
            for members, sign in ((left, 1), (right, -1)):
                for i in members:
                    ways[i].append((len(odds), sign))
            odds.append(float(np.log(high / low)))
            heapq.heappush(heap, (low + high, first, left + right))
    lengths = np.array([len(way) for way in ways], np.int16)
    steps = np.array([step for way in ways for step in way], np.int64)
    return np.cumsum(lengths) - lengths, lengths, steps[:, 0], steps[:, 1].astype(np.float32), np.array(odds)


def _lowest_known(rest: DataFrame) -> int:
    """The count from which on words are known to all tasks, such that they are ``_KNOWN`` at most."""
    levels = rest.groupBy(F.floor(F.log2("n") * 16).alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("n"), F.max("n").alias("most"))
    words, lowest = 0, None
    for row in sorted(levels.collect(), key=lambda row: -row.n):
        words += row.words
        if words > _KNOWN:
            return lowest or row.most + 1
        lowest = row.n
    return lowest or 1


def initial(counts: DataFrame, vocabulary: int = VOCABULARY, classes: int = CLASSES, seed: int = 5) -> WindowModel:
    """Words, classes, trees and shares from the counts of the corpus, and untrained weights, by which words have their shares."""
    frequent = counts.orderBy(F.col("n").desc(), "word").limit(vocabulary).collect()
    held = np.ones(ENDINGS)
    for row in counts.groupBy("ending").agg(F.sum("n").alias("n")).collect():
        held[row.ending] += row.n
    for row in frequent:
        held[row.ending] -= row.n
    n = np.array([row.n for row in frequent], np.float64)
    place = np.minimum((np.cumsum(n) - n / 2) / max(n.sum(), 1) * classes, classes - 1).astype(np.int64)
    word_class = np.concatenate([np.arange(ENDINGS) % ENDING_CLASSES, ENDING_CLASSES + place])
    mass = np.concatenate([held, n])
    *trees, odds = _trees(word_class, mass)
    rest, known = counts.where(F.lit(False)), {}
    if frequent:
        last = frequent[-1]
        rest = counts.where((F.col("n") < last.n) | ((F.col("n") == last.n) & (F.col("word") > last.word)))
        lowest = _lowest_known(rest)
        known = {row.word: row.n for row in rest.where(F.col("n") >= lowest).select("word", "n").collect()}
        rest = rest.where((F.col("n") < lowest) & (F.col("n") > 1))
    share = np.concatenate([-np.log(held), np.zeros(len(n))])
    ids = {row.word: ENDINGS + i for i, row in enumerate(frequent)}
    model = WindowModel(ids, word_class, share, *trees, np.zeros(0), rest, known)
    random = np.random.default_rng(seed)
    *shapes, branches, _ = model.shapes()
    layers = [
        random.normal(0, 1 / np.sqrt(shape[0]) if i else 0.3, shape) if len(shape) > 1 else np.zeros(shape)
        for i, shape in enumerate(shapes)
    ]
    layers += [np.zeros(branches), odds]
    return replace(model, weights=np.concatenate([layer.ravel() for layer in layers]).astype(np.float32))


def _places(counts: np.ndarray) -> np.ndarray:
    """Places of all words where marks stand around each text."""
    first = np.cumsum(counts + 2 * SIDE) - counts - SIDE
    return np.arange(counts.sum()) + np.repeat(first - (np.cumsum(counts) - counts), counts)


def _windows(found: np.ndarray, counts: np.ndarray, mark: int) -> tuple[np.ndarray, np.ndarray]:
    """All words with marks around each text, and the places of the words."""
    places = _places(counts)
    row = np.full(len(found) + 2 * SIDE * len(counts), mark, np.min_scalar_type(mark))
    row[places] = found
    return row, places


def _rest(different: pa.Array, place: np.ndarray, found: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Words of each text that have no number of their own, as often as they occur."""
    at = np.flatnonzero(found < ENDINGS)
    ends = np.searchsorted(at, np.cumsum([0, *counts]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), different.take(pa.array(place[at])))


def number_words(docs: DataFrame, model: WindowModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ids of every text with marks around it, ``_ids``, and its length ``_chars``; with ``keep``, these columns, the share of the
    known words ``_known`` and all other words that are not frequent, ``_rest``, too."""
    held = docs.sparkSession.sparkContext.broadcast(replace(model, rest=None))
    names = keep or []
    more = [F.lit(0.0).alias("_known"), F.expr("cast(array() as array<string>)").alias("_rest")]
    schema = docs.select(
        *names, F.lit(None).cast("binary").alias("_ids"), F.lit(0).alias("_chars"), *([] if keep is None else more)).schema

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        mark, listed = len(model.word_class), pa.array([*model.ids, *model.known], pa.string())
        own = np.concatenate([np.arange(mark), np.array([ending(word) for word in model.known], np.int64)])
        share = np.concatenate([np.zeros(mark), np.log(np.array(list(model.known.values()), np.float64))])
        for frame in batches(frames, text, _COUNTED_CHARS):
            texts = frame.column(text).to_pylist()
            words, counts = _words(texts)
            found, different, place = _numbers(words, listed)
            row, _ = _windows(own.take(found), counts, mark)
            ends = np.cumsum([0, *(counts + 2 * SIDE)]) * row.itemsize
            columns = [
                pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(row)]),
                pa.array([len(value or "") for value in texts], pa.int32())]
            if keep is not None:
                owner = np.repeat(np.arange(len(texts)), counts)
                columns += [pa.array(np.bincount(owner, share.take(found), len(texts))), _rest(different, place, found, counts)]
            yield pa.RecordBatch.from_arrays([*[frame.column(name) for name in names], *columns], schema.names)

    return docs.mapInArrow(run, schema)


def _numbered(frames: Iterator[pa.RecordBatch], mark: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The arriving batches of ``number_words``, cut by the lengths of texts: the batch, its row of ids and words of each text."""
    kind = np.min_scalar_type(mark)
    for frame in frames:
        for start, end in portions(frame.column("_chars").to_pylist(), _PORTION):
            part = frame.slice(start, end - start)
            each = part.column("_ids").to_pylist()
            counts = np.array([len(ids) for ids in each], np.int64) // kind.itemsize - 2 * SIDE
            yield part, np.frombuffer(b"".join(each), kind), counts


def _context(row: np.ndarray, places: np.ndarray) -> np.ndarray:
    return row.take(places[:, None] + _AROUND)


def _logits(layers: list[np.ndarray], context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input, hidden layer and, a row for each class, log-odds of the classes against the likeliest."""
    embedding, inner, inner_shift, outer, outer_shift = layers[:5]
    given = embedding.take(context.ravel(), axis=0).reshape(len(context), -1)
    hidden = given @ inner
    hidden += inner_shift
    np.maximum(hidden, 0, out=hidden)
    logits = outer.T @ hidden.T
    logits += outer_shift[:, None]
    logits -= logits.max(axis=0)
    return given, hidden, logits


def _forward(layers: list[np.ndarray], context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input, hidden layer and log-probabilities of the classes."""
    given, hidden, logits = _logits(layers, context)
    return given, hidden, (logits - np.log(np.exp(logits).sum(axis=0))).T


def _met(layers: list[np.ndarray], hidden: np.ndarray, ways: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At each step, the weights of its node, the hidden layer and the log-odds of the branch that is taken."""
    place, node, sign = ways
    weights, above = layers[5].take(node, axis=0), hidden.take(place, axis=0)
    return weights, above, sign * (np.einsum("ij,ij->i", weights, above) + layers[6].take(node))


def _lean(layers: list[np.ndarray], hidden: np.ndarray, ways: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Log-odds of the branch that is taken at each step."""
    return _met(layers, hidden, ways)[2]


@lru_cache(8)
def _cells(rows: int, width: int) -> np.ndarray:
    """Places of the cells of each row."""
    return np.arange(rows * width).reshape(rows, width)


def _subtract(array: np.ndarray, index: np.ndarray, values: np.ndarray) -> None:
    """``np.subtract.at`` over rows of even width, by pairs of numbers taken as complex ones, which is several times faster."""
    pair = np.result_type(array.dtype, np.complex64)
    cells = _cells(len(array), array.shape[1] // 2).take(index, axis=0)
    np.subtract.at(array.reshape(-1).view(pair), cells.ravel(), values.reshape(-1).view(pair))


def _add_runs(array: np.ndarray, place: np.ndarray, values: np.ndarray) -> None:
    """``np.add.at`` over rows, where ``place`` mostly counts up."""
    cuts = [0, *(np.flatnonzero(np.diff(place) != 1) + 1).tolist(), len(place)]
    for start, end in zip(cuts, cuts[1:]):
        if end > start:
            array[place[start]:place[end - 1] + 1] += values[start:end]


def _learn(layers: list[np.ndarray], context: np.ndarray, target: np.ndarray, pace: float,
           ways: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> None:
    """One gradient step in place, on the classes ``target`` and the ``ways`` in them."""
    embedding, inner, inner_shift, outer, outer_shift = layers[:5]
    given, hidden, slope = _logits(layers, context)
    rate = hidden.dtype.type(pace / len(target))
    np.exp(slope, out=slope)
    slope *= rate / (np.ones(len(slope), slope.dtype) @ slope)
    slope[target, np.arange(len(target))] -= rate
    back = slope.T @ outer.T
    if ways is not None:
        place, node, sign = ways
        weights, above, lean = _met(layers, hidden, ways)
        pull = -rate * sign / (1 + np.exp(np.clip(lean, -60, 60)))
        weights *= pull[:, None]
        above *= pull[:, None]
        _add_runs(back, place, weights)
        _subtract(layers[5], node, above)
        layers[6] -= np.bincount(node, pull, len(layers[6]))
    back *= hidden > 0
    below = back @ inner.T
    outer -= (slope @ hidden).T
    each = np.ones(len(target), slope.dtype)
    outer_shift -= slope @ each
    inner -= given.T @ back
    inner_shift -= each @ back
    _subtract(embedding, context.ravel(), below.reshape(-1, EMBEDDING))


def learn_round(docs: DataFrame, model: WindowModel, number: int, stride: int = ROUNDS, text: str = "text", pace: float = 1.0) -> WindowModel:
    """One round: all tasks learn from ``model``; their weights are averaged by the number of positions."""
    return _learn_numbers(number_words(docs.select(text), model, text), model, number, stride, pace)


def _learn_numbers(numbers: DataFrame, model: WindowModel, number: int, stride: int, pace: float = 1.0) -> WindowModel:
    """A round over what ``number_words`` made of the documents."""
    held = numbers.sparkSession.sparkContext.broadcast(replace(model, rest=None, ids={}, known={}))

    def learn(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        flat, seen, step = model.weights.copy(), 0, 0
        layers = model.layers(flat)
        for _, row, counts in _numbered(frames, len(model.word_class)):
            places = _places(counts)
            inner = np.arange(len(places)) - np.repeat(np.cumsum(counts) - counts, counts)
            places = places[inner % stride == number % stride]
            places = np.random.default_rng(number).permutation(places)
            start = 0
            while start < len(places):
                some = places[start:start + min(_LARGEST_STEP, _STEP * (1 + step // 100))]
                some = some.take(model.longest_first(row.take(some)))
                word = row.take(some)
                _learn(layers, _context(row, some), model.word_class.take(word), pace / np.sqrt(1 + step / 200), model.ways(word))
                step += 1
                start += len(some)
            seen += len(places)
        if seen:
            blocks = range(0, len(flat), _BLOCK)
            values = [flat[start:start + _BLOCK] for start in blocks]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(values)), pa.int32()), pa.array([TaskContext.get().partitionId() % _FAN_IN] * len(values), pa.int32()),
                 pa.array([seen] * len(values), pa.int64()), pa.array(values, pa.list_(pa.float32()))], ["block", "part", "seen", "mean"])

    def add(table: pa.Table) -> pa.Table:
        width = len(table.column("mean")[0])
        rows = table.column("mean").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        seen = table.column("seen").to_numpy()
        mean = (seen / seen.sum()) @ rows.astype(np.float64)
        return pa.table({
            "block": table.column("block").slice(0, 1), "part": table.column("part").slice(0, 1),
            "seen": pa.array([int(seen.sum())], pa.int64()), "mean": pa.array([mean.astype(np.float32)], pa.list_(pa.float32()))})

    schema = "block int, part int, seen bigint, mean array<float>"
    learned = numbers.select("_ids", "_chars").mapInArrow(learn, schema)
    once = learned.groupBy("block", "part").applyInArrow(add, schema)
    rows = once.groupBy("block").applyInArrow(add, schema).orderBy("block").collect()
    if not rows:
        return model
    return replace(model, weights=np.concatenate([np.array(row.mean, np.float32) for row in rows]))


def _begun(docs: DataFrame, text: str, vocabulary: int) -> tuple[WindowModel, int]:
    """An untrained model of the whole corpus, and its number of words."""
    counts = stored(word_counts(docs, text), "words")
    return initial(counts, vocabulary), counts.agg(F.sum("n")).first()[0] or 0


def _trained(numbers: DataFrame, model: WindowModel, words: int, rounds: int, stride: int | None) -> WindowModel:
    numbers = numbers.coalesce(max(1, words // _TASK_WORDS))
    for number in range(rounds):
        model = _learn_numbers(numbers, model, number, stride or rounds)
    return model


def train(docs: DataFrame, rounds: int = ROUNDS, stride: int | None = None, text: str = "text",
          vocabulary: int = VOCABULARY) -> WindowModel:
    """A model of the whole corpus; by default every position is a target in one of the rounds."""
    model, words = _begun(docs, text, vocabulary)
    numbers = stored(number_words(docs.select(text), model, text), "numbers")
    return _trained(numbers, model, words, rounds, stride)


def _score_row(row: np.ndarray, counts: np.ndarray, model: WindowModel) -> np.ndarray:
    """Summed conditional log-probability of each text in a row of ids."""
    places = _places(counts)
    layers, found = model.layers(model.weights), np.zeros(len(places))
    for start in range(0, len(places), _SCORED):
        some = places[start:start + _SCORED]
        _, hidden, logits = _logits(layers, _context(row, some))
        word = row.take(some)
        ways = model.ways(word)
        lean = _lean(layers, hidden, ways)
        inside = np.bincount(ways[0], np.maximum(-lean, 0) + np.log1p(np.exp(-np.abs(lean))), len(some))
        outside = logits[model.word_class.take(word), np.arange(len(some))] - np.log(np.exp(logits).sum(axis=0))
        found[start:start + _SCORED] = outside - inside + model.log_share.take(word)
    owner = np.repeat(np.arange(len(counts)), counts)
    return np.bincount(owner, found, len(counts)) if len(found) else np.zeros(len(counts))


def score_texts(texts: list[str | None], model: WindowModel) -> tuple[np.ndarray, np.ndarray]:
    """Number of words and summed conditional log-probability of each text, with words that are not frequent taken as met once."""
    words, counts = _words(texts)
    found, _, _ = _numbers(words, pa.array(list(model.ids), pa.string()))
    row, _ = _windows(found, counts, len(model.word_class))
    return counts, _score_row(row, counts, model)


def _rows(docs: DataFrame, model: WindowModel, text: str, keep_text: bool) -> tuple[DataFrame, list[str]]:
    """The numbers of all words in files, with a number for each row and the columns that pass; the names of these."""
    docs = docs.drop("n_words", "log_prob", "mean_log_prob")
    names = [name for name in docs.columns if keep_text or name != text]
    numbers = number_words(docs, model, text, names).withColumn("_row", F.monotonically_increasing_id())
    return stored(numbers, "numbers"), names


def _scored(numbers: DataFrame, model: WindowModel, names: list[str]) -> DataFrame:
    held = numbers.sparkSession.sparkContext.broadcast(replace(model, rest=None, ids={}, known={}))
    given = numbers.select(*names, "_row", "_known", "_ids", "_chars")
    passed = [*names, "_row"]
    schema = given.select(*passed, F.lit(0).cast("bigint").alias("n_words"), F.lit(0.0).alias("log_prob")).schema

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame, row, counts in _numbered(frames, len(held.value.word_class)):
            sums = _score_row(row, counts, held.value) + frame.column("_known").to_numpy()
            columns = [frame.column(name) for name in passed]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(sums)], schema.names)

    # The words that all tasks do not know meet their counts apart from the other columns.
    scored = given.mapInArrow(run, schema)
    words = numbers.select("_row", F.explode("_rest").alias("word")).join(model.rest.select("word", F.log("n").alias("_log")), "word")
    other = words.groupBy("_row").agg(F.sum("_log").alias("_other"))
    total = F.col("log_prob") + F.coalesce("_other", F.lit(0.0))
    return scored.join(other, "_row", "left").select(
        *names, "n_words", total.alias("log_prob"), (total / F.greatest("n_words", F.lit(1))).alias("mean_log_prob"))


def score(docs: DataFrame, model: WindowModel, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_words``, ``log_prob`` and ``mean_log_prob``; every other column passes, ``text`` only if asked for."""
    numbers, names = _rows(docs, model, text, keep_text)
    return _scored(numbers, model, names)


def train_and_score(docs: DataFrame, rounds: int = ROUNDS, stride: int | None = None, text: str = "text",
                    vocabulary: int = VOCABULARY, keep_text: bool = True) -> DataFrame:
    """``score`` of ``docs`` by the model that ``train`` makes of them; their words are numbered once for both."""
    model, words = _begun(docs, text, vocabulary)
    numbers, names = _rows(docs, model, text, keep_text)
    return _scored(numbers, _trained(numbers, model, words, rounds, stride), names)
