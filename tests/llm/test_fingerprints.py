import hashlib
import random
import re
from itertools import islice

import numpy as np
import odd
import pytest

from tabletop.llm import fingerprints as P
from tabletop.llm.queries import op9_fingerprints


def spots(text):
    """Spots in plain code, as tuples."""
    words = re.findall(r"[^\W_]+", text.lower())
    common, found = set(P.ANCHORS), set()
    for i, word in enumerate(words):
        if word in common:
            after = (words[j] for j in range(i, len(words)) if words[j] not in common)
            chain = islice(after, P.CHAIN)
            found.add((word, *chain))
    return found or {(word,) for word in words} or ({text} if text else set())


def share(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, docs):
    docs = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), d[1]))
    found = {}
    for row in rows:
        found.setdefault(row.doc_id, []).append(row)
    assert sum(map(len, found.values())) == len(docs)
    for place, (doc_id, text) in enumerate(docs):
        after = docs[(place + 1) % len(docs)][1]
        edited = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        row = next(r for r in found[doc_id] if r.edited_sha256 == digest and r.n_chars == len(text))
        found[doc_id].remove(row)
        assert len(row.fingerprint) == 8 * len(spots(text)) and len(row.edited_fingerprint) == 8 * len(spots(edited))
        assert np.isclose(row.near_edited, share(spots(text), spots(edited)))
        assert np.isclose(row.near_next, share(spots(text), spots(after)))


def test_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    check(op9_fingerprints(spark, small).collect(), [tuple(row) for row in docs.collect()])


def test_odd_rows_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(P, "_ROWS_A_RANGE", 3)
    check(P.with_next(odd.documents(spark)).collect(), [(row[0], row[1] or "") for row in odd.ROWS])
    monkeypatch.setattr(P, "_PORTION", 10)
    check(P.with_next(odd.documents(spark)).collect(), [(row[0], row[1] or "") for row in odd.ROWS])


def test_few_rows(spark):
    assert P.with_next(odd.nothing(spark)).count() == 0
    for text in (None, "", "one two"):
        df = spark.createDataFrame([(5, text)], "doc_id bigint, text string")
        check(P.with_next(df).collect(), [(5, text or "")])


def test_equal_texts_and_likeness(spark):
    rows = P.fingerprints(odd.documents(spark)).select("text", "fingerprint", "n_spots").collect()
    by_text = {}
    for row in rows:
        assert by_text.setdefault(row.text or "", row.fingerprint) == row.fingerprint and len(row.fingerprint) == 8 * row.n_spots
    a, b = np.arange(10, dtype=np.uint32), np.arange(5, 15, dtype=np.uint32)
    assert P.likeness(a, b) == 5 / 15 and P.likeness(a, a) == 1 and P.likeness(a, b[:0]) == 0 and P.likeness(a[:0], b[:0]) == 1
    assert P.likeness(a, a[:3], least=0.5) == 0


def brute(docs, least):
    """Classes and links by comparing all pairs of fingerprints."""
    sets = [spots(text or "") for _, text in docs]
    links, groups = [0] * len(docs), [{i} for i in range(len(docs))]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and None not in (docs[i][0], docs[j][0]) and share(a, b) >= least - 1e-12:
                links[i], links[j] = links[i] + 1, links[j] + 1
                joined = groups[i] | groups[j]
                for k in joined:
                    groups[k] = joined
    least_id = lambda group: min((docs[k][0] for k in group), key=lambda x: (x is None, x))
    return sorted(((d[0], least_id(groups[i]), links[i]) for i, d in enumerate(docs)), key=repr)


@pytest.mark.parametrize(("least", "block_rows"), [(0.8, 1000), (0.5, 3)])
def test_similar_against_brute_force(spark, least, block_rows):
    source = random.Random(6)
    docs = []
    for _ in range(25):
        text = [source.choice(["the", "of", "is"] + [f"w{i}" for i in range(40)]) for _ in range(source.randint(5, 90))]
        for _ in range(source.randint(1, 6)):
            copy = [word if source.random() > 0.02 else "new" for word in text] + ["end"] * source.randint(0, 2)
            docs.append((len(docs), " ".join(copy)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = sorted(map(tuple, P.similar(df, least, block_rows).collect()), key=repr)
    assert found == brute(docs, least)


def test_similar_odd_rows(spark):
    docs = [(row[0], row[1]) for row in odd.ROWS]
    assert sorted(map(tuple, P.similar(odd.documents(spark)).collect()), key=repr) == brute(docs, 0.8)
    assert P.similar(odd.nothing(spark)).count() == 0
