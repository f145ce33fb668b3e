"""Quality of a text by a sparse ensemble of rules over its statistics.

The statistics of a whole text are taken by Arrow batches. On a sample of labelled rows, boosted trees of small depth are
grown; every path from a root to a node is a rule, a conjunction of conditions on statistics. A logistic regression with
an L1 penalty keeps few of them, and those are compiled into one Spark column expression, which scores all rows.

Only the fit sees a sample: at most ``max_rows`` different pairs of statistics and label, those with the smallest hash of
the statistics, each weighted by its number of rows. The sample is even over different statistics and the same in every run. Statistics and scores cover all rows and all of every text.

Defined results: a null text has the statistics of the empty text. Without labelled rows every score is 0.5; with one
label only, every score is that label's rate. Null labels, and labels other than 0 and 1, teach nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletop.llm.common import batches

STATISTICS = [
    "log_chars", "log_words", "word_length", "upper", "digits", "symbols", "white", "new_words", "same_as_before",
    "top_word", "new_lines", "marks_per_word", "bars_per_word", "longest_word", "stops_per_word", "letters",
]
_SCHEMA = T.StructType([T.StructField(name, T.DoubleType(), False) for name in STATISTICS])
_OTHER, _LETTER, _UPPER, _DIGIT, _WHITE = range(5)


@cache
def _classes() -> np.ndarray:
    """The class of every character code."""
    kinds = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            kinds[code] = _UPPER if char.isupper() else _LETTER
        elif char.isdigit():
            kinds[code] = _DIGIT
        elif char.isspace():
            kinds[code] = _WHITE
    return kinds


def text_statistics(text: str | None) -> tuple[float, ...]:
    """Statistics of one text, in the order of ``STATISTICS``; shares of an empty text are 0."""
    text = text or ""
    counts = np.zeros(5, np.int64)
    for start in range(0, len(text), 1_000_000):
        codes = np.frombuffer(text[start:start + 1_000_000].encode("utf-32-le", "surrogatepass"), np.uint32)
        counts += np.bincount(_classes()[codes], minlength=5)
    words = text.split()
    frequency = Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    chars, n, letters = max(1, len(text)), max(1, len(words)), int(counts[_LETTER] + counts[_UPPER])
    return (
        float(np.log1p(len(text))),
        float(np.log1p(len(words))),
        sum(map(len, words)) / n,
        counts[_UPPER] / max(1, letters),
        counts[_DIGIT] / chars,
        counts[_OTHER] / chars,
        counts[_WHITE] / chars,
        len(frequency) / n,
        sum(map(eq, words, words[1:])) / n,
        max(frequency.values(), default=0) / n,
        len(set(lines)) / max(1, len(lines)),
        text.count("!") / n,
        text.count("|") / n,
        float(np.log1p(max(map(len, frequency), default=0))),
        text.count(".") / n,
        letters / chars,
    )


def with_statistics(docs: DataFrame, text: str = "text", column: str = "statistics") -> DataFrame:
    """``docs`` with the struct ``column`` of all statistics; an earlier column of that name goes."""
    docs = docs.drop(column)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, _SCHEMA, False)])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames, text):
            rows = np.array([text_statistics(value) for value in frame.column(text).to_pylist()], np.float64)
            rows = rows.reshape(-1, len(STATISTICS))
            struct = pa.StructArray.from_arrays(
                [pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(STATISTICS))], STATISTICS)
            yield pa.RecordBatch.from_arrays([*frame.columns, struct], [*frame.schema.names, column])

    return docs.mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """Holds where every statistic lies in its bounds: above the lower one, not above the upper one."""

    bounds: tuple[tuple[str, float, float], ...]

    def holds(self, rows: np.ndarray) -> np.ndarray:
        found = np.ones(len(rows), bool)
        for name, low, high in self.bounds:
            value = rows[:, STATISTICS.index(name)]
            found &= (value > low) & (value <= high)
        return found

    def column(self, statistics: str) -> Column:
        parts = []
        for name, low, high in self.bounds:
            value = F.col(f"{statistics}.{name}")
            parts += [value > low] if np.isfinite(low) else []
            parts += [value <= high] if np.isfinite(high) else []
        whole = parts[0]
        for part in parts[1:]:
            whole &= part
        return whole


@dataclass(frozen=True)
class RuleEnsemble:
    """Log-odds: ``intercept`` plus the weights of the rules that hold."""

    intercept: float
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]

    def score(self, statistics: str = "statistics") -> Column:
        """Probability of label 1 as a column expression over the struct ``statistics``."""
        odds = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            odds += F.when(rule.column(statistics), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def _grow(binned: np.ndarray, cuts: list[np.ndarray], slope: np.ndarray, curve: np.ndarray, depth: int, copies: np.ndarray) -> tuple:
    """One tree on gradients: the rule of every node but the root, and the step of every row."""
    rules: list[Rule] = []
    step = np.zeros(len(binned))

    def split(rows: np.ndarray, bounds: dict[int, tuple[float, float]], level: int) -> None:
        if bounds:
            named = ((STATISTICS[f], *ends) for f, ends in sorted(bounds.items()))
            rules.append(Rule(tuple(named)))
        total, weight = slope[rows].sum(), curve[rows].sum()
        best = (1e-3, -1, 0)
        if level < depth and copies[rows].sum() >= 20:
            for feature, edges in enumerate(cuts):
                if not len(edges):
                    continue
                size = len(edges) + 1
                values = binned[rows, feature]
                left = np.cumsum(np.bincount(values, slope[rows], size))[:-1]
                mass = np.cumsum(np.bincount(values, curve[rows], size))[:-1]
                gain = left**2 / (mass + 1) + (total - left)**2 / (weight - mass + 1) - total**2 / (weight + 1)
                place = int(gain.argmax())
                if gain[place] > best[0]:
                    best = (float(gain[place]), feature, place)
        _, feature, place = best
        if feature < 0:
            step[rows] = total / (weight + 1)
            return
        low, high = bounds.get(feature, (-np.inf, np.inf))
        edge = float(cuts[feature][place])
        left = binned[rows, feature] <= place
        split(rows[left], {**bounds, feature: (low, min(high, edge))}, level + 1)
        split(rows[~left], {**bounds, feature: (max(low, edge), high)}, level + 1)

    split(np.arange(len(binned)), {}, 0)
    return rules, step


def fit_rules(rows: np.ndarray, labels: np.ndarray, trees: int = 30, depth: int = 3, penalty: float = 0.002,
              copies: np.ndarray | None = None) -> RuleEnsemble:
    """Rules from boosted trees, weighted by a logistic regression with an L1 penalty on rules of equal spread.

    A row with a number of ``copies`` counts like so many rows.
    """
    if not len(labels):
        return RuleEnsemble(0.0, (), ())
    copies = np.ones(len(labels)) if copies is None else copies
    share = copies / copies.sum()
    rate = float(share @ labels)
    if len(np.unique(labels)) == 1:
        rate = float(labels[0])
    if rate in (0.0, 1.0):
        return RuleEnsemble(float(np.log((rate + 1e-9) / (1 - rate + 1e-9))), (), ())
    cuts = []
    for feature in range(rows.shape[1]):
        values = np.unique(rows[:, feature])
        middles = (values[1:] + values[:-1]) / 2
        cuts.append(middles if len(middles) <= 64 else np.unique(np.quantile(middles, np.linspace(0, 1, 64))))
    binned = np.stack([np.searchsorted(edges, rows[:, f], side="left") for f, edges in enumerate(cuts)], axis=1)
    odds, found = np.full(len(labels), np.log(rate / (1 - rate))), {}
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-odds))
        rules, step = _grow(binned, cuts, copies * (labels - chance), copies * chance * (1 - chance), depth, copies)
        odds = odds + 0.3 * step
        found.update(dict.fromkeys(rules))
    rules = list(found)
    if not rules:
        return RuleEnsemble(float(np.log(rate / (1 - rate))), (), ())
    table = np.stack([rule.holds(rows) for rule in rules], axis=1).astype(np.float64)
    mean = share @ table
    spread = np.maximum(np.sqrt(share @ (table - mean)**2), 1e-3)
    table = (table - mean) / spread
    # Accelerated proximal gradient; the step is set by the largest eigenvalue of the curvature.
    stride = 4 / max(float(np.linalg.eigvalsh(table.T @ (share[:, None] * table))[-1]), 1e-9)
    weights = ahead = np.zeros(len(rules))
    start = ahead_start = float(np.log(rate / (1 - rate)))
    pace = 1.0
    for _ in range(400):
        error = share * (1 / (1 + np.exp(-(table @ ahead + ahead_start))) - labels)
        moved = ahead - stride * (table.T @ error)
        moved = np.sign(moved) * np.maximum(np.abs(moved) - stride * penalty, 0)
        moved_start = ahead_start - 4 * error.sum() / 2
        next_pace = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        ahead = moved + (pace - 1) / next_pace * (moved - weights)
        ahead_start = moved_start + (pace - 1) / next_pace * (moved_start - start)
        weights, start, pace = moved, moved_start, next_pace
    kept = np.flatnonzero(np.abs(weights) > 1e-4)
    scaled = weights / spread
    return RuleEnsemble(
        float(start - (scaled * mean)[kept].sum()), tuple(rules[i] for i in kept), tuple(float(scaled[i]) for i in kept))


def train(labelled: DataFrame, label: str = "label", statistics: str = "statistics", max_rows: int = 20_000) -> RuleEnsemble:
    """Fit on at most ``max_rows`` different rows of ``labelled`` (struct ``statistics``, integer ``label``) and their numbers."""
    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(label).alias("label"), F.col(statistics).alias("s"))
    names = [F.col("s")[name].alias(name) for name in STATISTICS]
    counted = rows.select("label", *names).groupBy("label", *STATISTICS).agg(F.count("*").alias("copies"))
    taken = counted.orderBy(F.xxhash64(*STATISTICS), "label", *STATISTICS).limit(max_rows)
    taken = taken.toArrow()
    table = np.stack([taken.column(name).to_numpy() for name in STATISTICS], axis=1).reshape(-1, len(STATISTICS))
    labels = taken.column("label").to_numpy().astype(np.float64)
    order = np.lexsort((labels, *table.T))
    return fit_rules(table[order], labels[order], copies=taken.column("copies").to_numpy().astype(np.float64)[order])
