import hashlib
import random
import zlib

import numpy as np
import odd
import pytest
from checker import compare, connect

from tabletop.llm import repeats as R
from tabletop.llm.queries import CHECKS, op12_runs


def brute(words, least=6, times=4):
    """Runs by comparing all words with those q later, smallest period first."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(least, times * q):
                found.setdefault((start, length), q)
            i += 1
    return sorted((start, length, q) for (start, length), q in found.items())


def kept(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(word for i, word in enumerate(words) if i not in gone)


def texts(seed, number, letters, longest):
    random.seed(seed)
    for _ in range(number):
        words = [random.choice(letters) for _ in range(random.randrange(longest))]
        for _ in range(random.randrange(3)):
            at = random.randrange(len(words) + 1)
            words[at:at] = words[at:at + random.randrange(1, 8)] * random.randrange(1, 9)
        yield " ".join(words)


@pytest.mark.parametrize("least, times", [(6, 4), (4, 2), (1, 2), (10, 3)])
@pytest.mark.parametrize("letters, longest", [("a", 30), ("ab", 60), ("abc", 200), ("abcdefghijklmnop", 300)])
def test_against_brute_force(letters, longest, least, times):
    some = list(texts(len(letters), 60, letters, longest))
    counts, found, collapsed = R.texts_with_runs([text.encode() for text in some], least, times)
    for i, text in enumerate(some):
        words = text.split()
        expected = brute(words, least, times)
        assert counts[i] == len(words) and [tuple(row[1:]) for row in found[found[:, 0] == i]] == expected
        assert collapsed[i].decode() == kept(words, expected)


def test_long_period_and_limits():
    random.seed(3)
    words = [str(random.random()) for _ in range(5000)]
    text = " ".join(words * 4 + words[:7]).encode()
    _, found, collapsed = R.texts_with_runs([text, b"x " * 30000, b" ".join(text.split()[:-8])])
    assert found.tolist() == [[0, 0, 20007, 5000], [1, 0, 30000, 1]]
    assert collapsed[0].decode().split() == words and collapsed[1] == b"x"


def test_ranks_are_those_of_sorted_suffixes():
    random.seed(1)
    codes = np.array([random.randrange(3) for _ in range(300)])
    counts = np.array([100, 0, 199, 1])
    ends, owner = np.cumsum(counts), np.repeat(np.arange(4), counts)
    expected = sorted(range(300), key=lambda i: (owner[i], codes[i:ends[owner[i]]].tolist()))
    assert np.argsort(R.ranks(codes, owner, ends)[-1][:-1]).tolist() == expected


def test_odd_rows(spark):
    rows = R.collapse(odd.documents(spark).withColumn("runs", odd_column())).collect()
    assert len(rows) == len(odd.ROWS) and set(odd.CLASHING) <= set(rows[0].asDict())
    for row in rows:
        words = (row.text or "").encode().split()
        assert row.n_words == len(words)
        if row.doc_id != 8:
            assert [tuple(run) for run in row.runs] == brute(words)
    long = next(row for row in rows if row.doc_id == 8)
    assert [tuple(run) for run in long.runs] == [(0, 15 * 4000, 15)] and len(long.collapsed.split()) == 15
    assert R.collapse(odd.nothing(spark)).collect() == []


def odd_column():
    from pyspark.sql import functions as F

    return F.lit("other")


def edited(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [word if i < a else words[a + (i - a) % p] for i, word in enumerate(words)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    found = {row.doc_id: row for row in op12_runs(spark, small).collect()}
    assert len(found) == len(docs) and sum(row.n_runs > 0 for row in found.values()) > 10
    for doc in docs:
        words = edited(doc.doc_id, doc.text.split())
        runs, row = brute(words), found[doc.doc_id]
        best = max(runs, key=lambda run: (run[1], -run[0], -run[2]), default=(None, None, None))
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (best[1] * 1000 // best[2] if runs else None)
        assert row.runs_sha256 == sha("".join(f"{a},{b},{c}\n" for a, b, c in runs))
        assert row.collapsed_sha256 == sha(kept(words, runs))


def test_query_on_odd_tables(spark, tmp_path):
    odd.documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    rows = op12_runs(spark, str(tmp_path)).collect()
    assert len(rows) == len(odd.ROWS) and all(row.collapsed_sha256 and row.runs_sha256 for row in rows)
    assert {row.n_runs for row in rows if row.doc_id in (4, 5)} == {0}


def test_against_sql(spark, small):
    assert compare(op12_runs(spark, small).toArrow(), connect(small).sql(CHECKS["op12_runs"]).to_arrow_table()) == []
