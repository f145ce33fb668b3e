"""Greedy longest-match token counts by a linear automaton.

The pieces of a vocabulary form a trie. Every node knows, for the case that no edge fits, where matching goes on (its
failure link) and how many pieces are finished on the way (its pops), so a word is read once, symbol by symbol, and
no piece is ever built. Each process keeps the counts of what it has met between white space in tables of bounded size.

The vocabulary is that of a word BPE file, whose end mark closes a word; all single bytes, closing a word or not, are pieces,
so every word can be cut. Words are found and normalised as the file says. The trie is built in each process from the broadcast file.

Defined results: null and empty texts have no words and no tokens. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletop.llm import bpe
from tabletop.llm.common import batches

_CACHED = 150_000
# Added to a byte that closes a word: with its end mark, it is a symbol of its own.
_CLOSED = 256


class LongestMatch:
    """Automaton over sequences of symbols; ``pieces`` are sequences too."""

    def __init__(self, pieces: Iterable[tuple]):
        self.edges: list[dict] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for symbol in piece:
                following = self.edges[node].get(symbol)
                if following is None:
                    following = self.edges[node][symbol] = len(self.edges)
                    self.edges.append({})
                    final.append(False)
                node = following
            final[node] = final[node] or bool(piece)
        self.failure = [-1] * len(self.edges)
        self.pops = [0] * len(self.edges)
        level = [0]
        while level:
            deeper = []
            for node in level:
                for symbol, child in self.edges[node].items():
                    deeper.append(child)
                    if final[child]:
                        self.failure[child], self.pops[child] = 0, 1
                        continue
                    link, popped = self.failure[node], self.pops[node]
                    while link >= 0 and symbol not in self.edges[link]:
                        popped += self.pops[link]
                        link = self.failure[link]
                    if link >= 0:
                        self.failure[child], self.pops[child] = self.edges[link][symbol], popped
            level = deeper

    def count(self, symbols: Iterable) -> int | None:
        """Number of greedy longest pieces, or None if some symbol starts no piece."""
        edges, failure, pops = self.edges, self.failure, self.pops
        node = total = 0
        for symbol in symbols:
            while (following := edges[node].get(symbol)) is None:
                total += pops[node]
                node = failure[node]
                if node < 0:
                    return None
            node = following
        while node > 0:
            total += pops[node]
            node = failure[node]
        return total if node == 0 else None


class TokenCounter:
    """Counts for the texts of one vocabulary file."""

    def __init__(self, content: str):
        self.bpe = bpe.load(content)
        byte_of = {symbol: byte for byte, symbol in enumerate(bpe.byte_symbols())}
        end = self.bpe.end

        def symbols(piece: str) -> tuple:
            if end and piece.endswith(end):
                *inner, last = (byte_of[char] for char in piece[:-len(end)])
                return (*inner, last + _CLOSED)
            return tuple(byte_of[char] for char in piece)

        self.match = LongestMatch(symbols(piece) for piece in self.bpe.ids)
        self.known = bpe.Known(self._stretch, _CACHED)

    def word(self, word: str) -> int:
        symbols = [*word.encode("utf-8", "surrogatepass")]
        symbols[-1] += _CLOSED if self.bpe.end else 0
        return self.match.count(symbols)

    def _stretch(self, stretch: str) -> tuple[int, int]:
        words = self.bpe.word.findall(stretch)
        return len(words), sum(map(self.word, words))

    def text(self, text: str | None) -> tuple[int, int]:
        """Words and tokens of a text; a special token counts as one word and one token."""
        words = tokens = 0
        for part in self.bpe.parts(text or ""):
            if part in self.bpe.special:
                words, tokens = words + 1, tokens + 1
                continue
            for stretches in self.bpe.stretches(part):
                pairs = [self.known[stretch] for stretch in stretches]
                words += sum(pair[0] for pair in pairs)
                tokens += sum(pair[1] for pair in pairs)
        return words, tokens


_LOADED: dict[str, TokenCounter] = {}


def load(content: str) -> TokenCounter:
    """The counter for a vocabulary file's content, built once in a process."""
    if content not in _LOADED:
        _LOADED.clear()
        _LOADED[content] = TokenCounter(content)
    return _LOADED[content]


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with the columns ``n_words`` and ``n_tokens``; every other column passes."""
    with open(path, encoding="utf-8") as file:
        held = docs.sparkSession.sparkContext.broadcast(file.read())
    docs = docs.drop("n_words", "n_tokens")
    zero = F.lit(0).cast("bigint")
    schema = docs.select("*", zero.alias("n_words"), zero.alias("n_tokens")).schema

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(held.value)
        for frame in batches(frames, text):
            counts = [counter.text(value) for value in frame.column(text).to_pylist()]
            more = [pa.array([pair[i] for pair in counts], pa.int64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*frame.columns, *more], schema.names)

    return docs.mapInArrow(run, schema)
