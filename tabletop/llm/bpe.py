"""Byte pair encoding of words by a queue of merge ranks over a linked list of symbols, and decoding.

A vocabulary file of the tokenizers library (words with an end mark) is read at a given path on the driver and sent to
the tasks once; its size is that of the file. A word is a doubly linked list of symbols; a heap holds the adjacent pairs
that can merge, the lowest rank first and the leftmost among equals. A popped pair whose symbols have changed since is
stale and skipped. Each process keeps what it has met between white space in two tables of bounded size. Decoding joins the strings of the ids.

Defined results: a null text is encoded as the empty text, which has no ids and decodes to the empty string. Special
tokens in a text are their own ids. Ids are kept as little-endian unsigned 32-bit integers in one binary value. A text is
encoded whole; the words of a long one are handled in portions cut at white space. Unknown characters cannot occur, since
every byte is a symbol.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletop.llm.common import batches

# Python's split() also cuts at these four, which are not white space to the vocabulary's pattern.
_SEPARATORS = regex.compile("[\x1c-\x1f]")
_NOT_SPACE = regex.compile(r"\S+")
_PORTION = 1_000_000
_CACHED = 150_000


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte: printable Latin-1 stands for itself, others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(byte) if byte in plain else chr(next(others)) for byte in range(256)]


class Known(dict):
    """What is known of stretches without white space. What a full table held moves aside, and what is met again comes back."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self._encode, self._limit, self._aside = encode, limit, {}

    def __missing__(self, stretch: str) -> bytes:
        if len(self) >= self._limit:
            self._aside = dict(self)
            self.clear()
        ids = self._aside.get(stretch)
        if ids is None:
            ids = self._encode(stretch)
        self[stretch] = ids
        return ids


class WordBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, content: dict):
        model = content["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        pairs = [pair.split(" ", 1) if isinstance(pair, str) else pair for pair in model["merges"]]
        # The pair of each rank as one number, what it merges into, and the rank of each pair.
        self.pairs = [self.ids[left] << 32 | self.ids[right] for left, right in pairs]
        self.merged = [self.ids[left + right] for left, right in pairs]
        self.ranks = {pair: rank for rank, pair in enumerate(self.pairs)}
        self.special = {token["content"]: token["id"] for token in content.get("added_tokens", [])}
        strings = {number: piece for piece, number in [*self.ids.items(), *self.special.items()]}
        self.strings = [strings.get(number, "") for number in range(max(strings, default=-1) + 1)]
        split = next(p for p in content["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split["pattern"]["Regex"])
        names = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        symbols = byte_symbols()
        self.inner = [self.ids[symbol] for symbol in symbols]
        self.final = [self.ids[symbol + self.end] for symbol in symbols]
        self.known = Known(self.encode_stretch, _CACHED)

    def encode_word(self, word: str) -> bytes:
        """Ids of one word."""
        raw = word.encode("utf-8", "surrogatepass")
        ids = [self.inner[byte] for byte in raw]
        ids[-1] = self.final[raw[-1]]
        size, rank_of, pairs, results = len(ids), self.ranks.get, self.pairs, self.merged
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        queue = []
        for left in range(size - 1):
            if (rank := rank_of(ids[left] << 32 | ids[left + 1])) is not None:
                queue.append(rank << 32 | left)
        heapify(queue)
        while queue:
            first = heappop(queue)
            rank, left = first >> 32, first & 0xFFFFFFFF
            right = after[left]
            if right >= size or ids[left] << 32 | ids[right] != pairs[rank]:
                continue
            ids[left] = merged = results[rank]
            ids[right] = -1
            after[left] = follower = after[right]
            if follower < size:
                before[follower] = left
                if (rank := rank_of(merged << 32 | ids[follower])) is not None:
                    heappush(queue, rank << 32 | left)
            earlier = before[left]
            if earlier >= 0 and (rank := rank_of(ids[earlier] << 32 | merged)) is not None:
                heappush(queue, rank << 32 | earlier)
        whole = [number for number in ids if number >= 0]
        return struct.pack(f"<{len(whole)}I", *whole)

    def encode_stretch(self, stretch: str) -> bytes:
        """Ids of the words of a stretch without white space."""
        words = self.word.findall(stretch)
        if words == [stretch]:
            return self.encode_word(stretch)
        return b"".join([self.known[word] for word in words])

    def stretches(self, text: str) -> Iterator[list[str]]:
        """Stretches of a text between white space, in portions."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        start = 0
        while start < len(text):
            end = start + _PORTION
            while end < len(text) and text[end] != " ":
                end += 1
            yield _NOT_SPACE.findall(text[start:end]) if _SEPARATORS.search(text, start, end) else text[start:end].split()
            start = end

    def parts(self, text: str) -> list[str]:
        """A text cut at its special tokens, which are parts too."""
        parts = self.marks.split(text) if self.marks and self.marks.search(text) else [text]
        return [part for part in parts if part]

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        known = self.known
        found: list[bytes] = []
        for part in self.parts(text or ""):
            if part in self.special:
                found.append(struct.pack("<I", self.special[part]))
            else:
                for stretches in self.stretches(part):
                    found.append(b"".join([known[stretch] for stretch in stretches]))
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        """The strings of all ids, joined by blanks, as the file names no decoder of its own."""
        return " ".join(map(self.strings.__getitem__, memoryview(ids).cast("I")))


_LOADED: dict[str, WordBpe] = {}


def load(content: str) -> WordBpe:
    """The encoder for a vocabulary file's content, built once in a process."""
    if content not in _LOADED:
        _LOADED.clear()
        _LOADED[content] = WordBpe(json.loads(content))
    return _LOADED[content]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the binary column ``ids`` and, if named, the column ``decoded``, made from those ids alone."""
    with open(path, encoding="utf-8") as file:
        held = docs.sparkSession.sparkContext.broadcast(file.read())
    docs = docs.drop(ids, *([decoded] if decoded else []))
    more = [F.lit(b"").alias(ids), *([F.lit("").alias(decoded)] if decoded else [])]
    schema = docs.select("*", *more).schema

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(held.value)
        for frame in batches(frames, text):
            encoded = [model.encode(value) for value in frame.column(text).to_pylist()]
            columns = [*frame.columns, pa.array(encoded, pa.binary())]
            if decoded:
                columns.append(pa.array([model.decode(value) for value in encoded], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the column ``decoded``: the text of the binary column ``ids`` (null: empty)."""
    with open(path, encoding="utf-8") as file:
        held = docs.sparkSession.sparkContext.broadcast(file.read())
    docs = docs.drop(decoded)
    schema = docs.select("*", F.lit("").alias(decoded)).schema

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(held.value)
        for frame in frames:
            texts = [model.decode(value or b"") for value in frame.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(texts, pa.string())], schema.names)

    return docs.mapInArrow(run, schema)
