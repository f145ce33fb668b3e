import hashlib
import json
import struct

import odd
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabletop.llm import bpe, token_counts
from tabletop.llm.queries import VOCABULARY, op2_bpe

LIBRARY = Tokenizer.from_file(VOCABULARY)
with open(VOCABULARY, encoding="utf-8") as file:
    CONTENT = file.read()
MODEL = bpe.load(CONTENT)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=60))
def test_same_as_the_library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    coded = MODEL.encode(text)
    assert list(struct.unpack(f"<{len(coded) // 4}I", coded)) == ids
    assert MODEL.decode(coded) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_portions_and_full_tables(monkeypatch):
    text = "the quick\x1cbrown<|endoftext|> fox's 12 " * 300
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "_PORTION", 50)
    model = bpe.WordBpe(json.loads(CONTENT))
    model.known = bpe.Known(model.encode_stretch, 3)
    assert model.encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_odd_rows(spark):
    docs = odd.documents(spark)
    rows = bpe.encode(docs, VOCABULARY, decoded="decoded").collect()
    assert len(rows) == len(odd.ROWS)
    for row in rows:
        ids = LIBRARY.encode(row.text or "", add_special_tokens=False).ids
        assert bytes(row.ids) == struct.pack(f"<{len(ids)}I", *ids) and row.score == "other"
        assert row.decoded == LIBRARY.decode(ids, skip_special_tokens=False)
    again = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY).select("decoded").collect()
    assert sorted(row.decoded for row in again) == sorted(row.decoded for row in rows)
    assert bpe.encode(odd.nothing(spark), VOCABULARY).count() == 0


def test_query(spark, small):
    texts = dict(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    for row in op2_bpe(spark, small).collect():
        ids = LIBRARY.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def longest(symbols, pieces):
    """Greedy cut by trying all lengths."""
    count = start = 0
    while start < len(symbols):
        ends = [end for end in range(start + 1, len(symbols) + 1) if tuple(symbols[start:end]) in pieces]
        if not ends:
            return None
        start, count = max(ends), count + 1
    return count


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5), max_size=8), st.text("abc", max_size=20))
def test_automaton_is_greedy_longest_match(pieces, word):
    pieces = {tuple(piece) for piece in pieces}
    assert token_counts.LongestMatch(sorted(pieces)).count(word) == longest(word, pieces)


def naive_tokens(text):
    symbols, count, words = bpe.byte_symbols(), 0, 0
    for part in MODEL.parts(text or ""):
        if part in MODEL.special:
            count, words = count + 1, words + 1
            continue
        for stretches in MODEL.stretches(part):
            for word in (w for stretch in stretches for w in MODEL.word.findall(stretch)):
                units = [symbols[byte] for byte in word.encode()]
                units[-1] += "</w>"
                start = 0
                while start < len(units):
                    start = max(e for e in range(start + 1, len(units) + 1) if "".join(units[start:e]) in MODEL.ids)
                    count += 1
                words += 1
    return words, count


def test_token_counts(spark, small):
    rows = token_counts.count_tokens(odd.documents(spark), VOCABULARY).collect()
    assert len(rows) == len(odd.ROWS) and all((row.n_words, row.n_tokens) == naive_tokens(row.text) for row in rows)
    assert token_counts.count_tokens(odd.nothing(spark), VOCABULARY).count() == 0
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for row in token_counts.count_tokens(docs, VOCABULARY).limit(20).collect():
        assert (row.n_words, row.n_tokens) == naive_tokens(row.text)
