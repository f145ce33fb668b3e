"""Language of a text by multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of 1 to 3 characters per language in every task and sums them by Spark; the resulting matrix of
log-probabilities (buckets x languages) is the only thing that is broadcast. Its size is fixed by the number of buckets
and of languages, and the latter is checked. Scoring takes a batch of texts as one sparse matrix in row-pointer form
(row starts and bucket numbers) and multiplies it by the broadcast matrix with numpy.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if nothing could be
learned. Letters are lower-cased, every run of other characters is one blank. Ties go to the smaller language name.
Texts are read whole, long ones in slices that overlap. Only the named columns are read; others pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletop.llm.common import batches, portions

UNDETERMINED = "und"
BITS = 14
LENGTHS = (1, 2, 3)
MAX_LANGUAGES = 1000
_SLICE = 500_000


@dataclass(frozen=True)
class LanguageModel:
    """``log_prob[bucket, language]`` and ``log_prior[language]`` for sorted ``languages``."""

    languages: tuple[str, ...]
    log_prob: np.ndarray
    log_prior: np.ndarray


@cache
def _letters() -> np.ndarray:
    return np.array([chr(code).isalpha() for code in range(0x110000)])


def _normalised(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Character codes, the row of each, and how many of them repeat the end of the piece before.

    Only the pieces of one long text repeat codes: the longest n-gram less one.
    """
    for start, end in portions(texts, _SLICE):
        lowered = [f" {text.lower()} " for text in texts[start:end]]
        if end - start > 1 or len(lowered[0]) <= 2 * _SLICE:
            codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
            rows = np.repeat(np.arange(start, end), [len(text) for text in lowered])
            letter = _letters()[codes]
            keep = letter.copy()
            keep[1:] |= letter[:-1] | (rows[1:] != rows[:-1])
            keep[0] = True
            yield np.where(letter, codes, 32)[keep], rows[keep], 0
            continue
        tail, before = np.zeros(0, np.uint32), True
        for cut in range(0, len(lowered[0]), _SLICE):
            codes = np.frombuffer(lowered[0][cut:cut + _SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
            letter = _letters()[codes]
            keep = letter | np.concatenate([[before], letter[:-1]])
            before = bool(letter[-1])
            codes = np.concatenate([tail, np.where(letter, codes, 32)[keep]])
            yield codes, np.full(len(codes), start), len(tail)
            tail = codes[len(codes) - min(len(codes), max(LENGTHS) - 1):]


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and hashed n-grams of all ``texts``."""
    for codes, rows, repeated in _normalised(texts):
        mixed = codes.astype(np.uint32)
        for length in LENGTHS:
            if length > 1:
                mixed = mixed[:-1] * np.uint32(0x01000193) + codes[length - 1:].astype(np.uint32)
            if not len(mixed):
                break
            inside = rows[:len(mixed)] == rows[length - 1:]
            inside[:max(0, repeated - length + 1)] = False
            if length == 1:
                inside &= codes != 32
            bucket = (mixed ^ np.uint32(length * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            bucket = (bucket ^ (bucket >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)
            yield rows[:len(mixed)][inside], bucket[inside].astype(np.int64)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.5) -> LanguageModel:
    """Learn from all rows of ``docs`` with a text and a language; sums are made in every task before the shuffle."""
    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        sizes: dict[str, int] = {}

        def rows() -> pa.RecordBatch:
            langs, buckets, sums = [], [], []
            for name, array in counts.items():
                filled = np.flatnonzero(array)
                langs.append(pa.array([name] * (len(filled) + 1), pa.string()))
                buckets.append(np.concatenate([[-1], filled]))
                sums.append(np.concatenate([[sizes[name]], array[filled]]))
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(langs), pa.array(np.concatenate(buckets), pa.int32()),
                 pa.array(np.concatenate(sums), pa.int64())], ["lang", "bucket", "n"])

        for frame in batches(frames, "text"):
            texts, names = frame.column("text").to_pylist(), frame.column("lang").to_pylist()
            different = sorted(set(names))
            place = np.array([different.index(name) for name in names])
            summed = np.zeros((len(different), 1 << BITS), np.int64)
            for row, bucket in _grams(texts):
                summed += np.bincount(place[row] << BITS | bucket, minlength=summed.size).reshape(summed.shape)
            for position, name in enumerate(different):
                sizes[name] = sizes.get(name, 0) + int((place == position).sum())
                counts[name] = counts.get(name, 0) + summed[position]
            if len(counts) > 100:
                yield rows()
                counts.clear()
                sizes.clear()
        if counts:
            yield rows()

    labelled = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    languages = sorted(row[0] for row in labelled.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; is {lang} the right column?")
    counted = labelled.mapInArrow(count, "lang string, bucket int, n bigint")
    found = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    place = {name: position for position, name in enumerate(languages)}
    column = np.array([place[name] for name in found.column("lang").to_pylist()], np.int64)
    bucket, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    table = np.full((1 << BITS, len(languages)), smoothing)
    priors = np.ones(len(languages))
    gram = bucket >= 0
    np.add.at(table, (bucket[gram], column[gram]), n[gram])
    np.add.at(priors, column[~gram], n[~gram])
    log_prob = np.log(table) - np.log(table.sum(axis=0, keepdims=True)) if languages else table
    return LanguageModel(tuple(languages), log_prob, np.log(priors / max(priors.sum(), 1)))


def score_texts(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability of each text."""
    present = [text or "" for text in texts]
    total = np.tile(model.log_prior, (len(texts), 1))
    grams = np.zeros(len(texts), np.int64)
    step = max(10_000, 4_000_000 // max(1, len(model.languages)))
    for row, bucket in _grams(present) if model.languages else ():
        grams += np.bincount(row, minlength=len(texts))
        for cut in range(0, len(row), step):
            some = row[cut:cut + step]
            pointers = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
            total[some[pointers]] += np.add.reduceat(model.log_prob[bucket[cut:cut + step]], pointers, axis=0)
    if not model.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    best = total.argmax(axis=1)
    score = 1 / np.exp(total - total[np.arange(len(texts)), best][:, None]).sum(axis=1)
    return [model.languages[b] if n else UNDETERMINED for b, n in zip(best, grams)], np.where(grams > 0, score, 0.0)


def identify(
    docs: DataFrame, model: LanguageModel, text: str = "text", lang: str = "lang_pred", score: str = "lang_score"
) -> DataFrame:
    """``docs`` with the columns ``lang`` and ``score``; every other column passes, earlier ones of these names go."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(lang, score)
    schema = docs.select("*", F.lit("").alias(lang), F.lit(0.0).alias(score)).schema

    def predict(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames, text):
            langs, scores = score_texts(frame.column(text).to_pylist(), held.value)
            columns = [*frame.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.mapInArrow(predict, schema)
