import random
import re

import odd
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from tabletop.llm import mixing as M
from tabletop.llm.queries import op7_mixing

WORD = re.compile("[^\x20\x09-\x0d]+")


def water(sizes, share=1.5, most=2):
    """Targets by repeated resharing; ``sizes`` in order of the sources."""
    weights = [M.WEIGHTS[i % 3] for i in range(len(sizes))]
    total, found, open_ = share * sum(sizes), [None] * len(sizes), set(range(len(sizes)))
    while open_:
        each = (total - sum(t for t in found if t is not None)) / sum(weights[i] for i in open_)
        full = {i for i in open_ if each * weights[i] > most * sizes[i]}
        if not full:
            for i in open_:
                found[i] = each * weights[i]
            break
        for i in full:
            found[i] = most * sizes[i]
        open_ -= full
    return found


def check(rows, docs):
    """Sizes, targets and sums of ``rows`` against plain code over (doc_id, text, source)."""
    words = sorted((repr(i), len(WORD.findall(t or ""))) for i, t, _ in docs)
    assert sorted((repr(r.doc_id), r["size"]) for r in rows) == words
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s))
    sizes = [sum(len(WORD.findall(t or "")) for _, t, s in docs if s == source) for source in sources]
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    for source, size, target in zip(sources, sizes, water(sizes)):
        ids = {i for i, _, s in docs if s == source}
        own = [r for r in rows if r.doc_id in ids]
        assert all(r.source_size == size and r.target == pytest.approx(target) for r in own)
        assert abs(sum(r.taken for r in own) - target) <= 0.5 + 1e-6


def test_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source").collect()
    rows = op7_mixing(spark, small).collect()
    check(rows, docs)
    assert sorted(rows) == sorted(op7_mixing(spark, small).collect())


def test_odd_rows(spark):
    _, taken = M.mix(odd.documents(spark))
    rows = M.taken_words(taken).collect()
    # Ids in one source only: the repeated id 3 and the null id are.
    check(rows, [(row[0], row[1], row[3]) for row in odd.ROWS])
    assert M.taken_words(M.mix(odd.nothing(spark))[1]).count() == 0


def test_rows_of_one_id_and_text_keep_their_columns(spark):
    """Also where one source is taken twice and rows are repeated as a whole."""
    rows = [(1, "a b c", "x", "en"), (1, "a b c", "y", "de"), (1, "a b c", "y", "fr"), (2, "d e", "x", "en"), (2, "d e", "x", "en"),
            (None, "f g h", "y", None), (3, None, "y", "en"), (4, "", None, "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    _, taken = M.mix(docs)
    mixed = M.mixed_texts(docs, taken).collect()
    assert mixed and {(r.doc_id, r.source, r.lang) for r in mixed} <= {(i, s, lang) for i, _, s, lang in rows}
    by_source = {r.source: r.target for r in M.targets(M.measured(docs)).collect() if r.source}
    for source, target in by_source.items():
        assert abs(sum(len(r.text.split()) for r in mixed if r.source == source) - target) <= 0.5
    again = M.mixed_texts(docs.repartition(5), M.mix(docs.repartition(3, "lang"))[1]).collect()
    assert sorted(map(str, mixed)) == sorted(map(str, again))


def test_slots_of_large_targets_are_dealt_to_tasks(spark):
    sources = spark.createDataFrame(
        [("a", 10**9, 2e9, 1), ("b", 10**9, 1e9, 2)], "source string, source_size bigint, target double, source_no bigint")
    dealt = M.slots(sources)
    each = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert sum(row[1] for row in each) == 3 * 976_563 and len(each) >= 8


def test_small_blocks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(M, "_ROWS_A_BUCKET", 7)
    monkeypatch.setattr(M, "_SLOTS_A_CHUNK", 5)
    source = random.Random(2)
    docs = [(i, "w " * source.randint(0, 90), source.choice("aaab") if i % 9 else None) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    sizes = M.measured(df)
    sources = M.targets(sizes)
    placed = M.positions(sizes, sources)
    dealt = M.slots(sources, block_words=16, shard_slots=8).cache()
    rows = M.taken_words(M.spans(placed, dealt, 16)).collect()
    check(rows, docs)
    # A pass meets every block once at most, in an order of its own; shards share all slots.
    assert dealt.groupBy("source_no", "pass", "block").count().where("count > 1").count() == 0
    first = [r.block for r in dealt.where("source_no = 1 and pass = 0").orderBy("slot").collect()]
    assert sorted(first) == list(range(len(first))) and first != sorted(first)
    counts = M.shard_counts(dealt)
    assert counts.agg(F.sum("slots")).first()[0] == dealt.count() and counts.select("shard").distinct().count() > 5
    # The stream of a source is covered without gaps.
    spans = sorted((r.source, r.start, r["size"]) for r in placed.where("source = 'a' and size > 0").collect())
    assert all(a[1] + a[2] == b[1] for a, b in zip(spans, spans[1:])) and spans[0][1] == 0


def test_texts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    _, taken = M.mix(docs)
    mixed = M.mixed_texts(docs, taken)
    assert mixed.columns == docs.columns
    expected = M.taken_words(taken).agg(F.sum("taken")).first()[0]
    assert mixed.agg(F.sum(M.word_count(F.col("text")))).first()[0] == expected
    whole = {row.doc_id: row.text for row in docs.collect()}
    for row in mixed.collect():
        assert row.text == whole[row.doc_id] or set(row.text.split(" ")) <= set(WORD.findall(whole[row.doc_id]))
        assert row.n_chars == len(row.text)
    assert not re.search("Python|Arrow|Pandas", plan_of(mixed))
