import struct

import odd
from test_bpe import LIBRARY
from test_jaccard_join import sets

import corpus_pipeline
from tabletop.llm import mixing
from tabletop.llm.common import stored


def passed(spark, docs, folder):
    """The result of every stage, written and read again."""
    results = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), "stage")
        results.append(docs)
    return results


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    good, told, single, mixed, coded = passed(spark, docs, small)
    assert all(df.columns == docs.columns for df in (good, told, single, mixed))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    kept, all_ids = {r.doc_id for r in good.collect()}, {r.doc_id for r in docs.collect()}
    known = [i for i in all_ids if i in labels]
    assert sum((i in kept) == (labels[i] == 1) for i in known) >= 0.98 * len(known)
    lettered = {r.doc_id for r in good.collect() if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in told.collect()} == lettered
    # No two kept documents are near duplicates, and every dropped one has a kept relative further on.
    rows = single.collect()
    grams = sets([r.text for r in rows])
    assert all(len(a & b) < 0.8 * len(a | b) for i, a in enumerate(grams) for b in grams[:i])
    dropped = [r for r in told.collect() if r.doc_id not in {k.doc_id for k in rows}]
    others = sets([r.text for r in told.collect()])
    assert all(sum(len(a & b) >= 0.8 * len(a | b) for b in others) > 1 for a in sets([r.text for r in dropped]))
    _, taken = mixing.mix(single)
    assert mixed.agg({"n_chars": "sum"}).first()[0] > 0
    assert taken.agg({"words": "sum"}).first()[0] == mixed.select(mixing.word_count(mixed.text).alias("n")).agg({"n": "sum"}).first()[0]
    ids = sorted(LIBRARY.encode(r.text, add_special_tokens=False).ids for r in mixed.collect())
    found = sorted(list(struct.unpack(f"<{r.n_tokens}I", r.ids)) for r in coded.collect())
    assert found == ids


def test_odd_documents_and_none(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (None, 1, 1), (99, None, 0)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd.documents(spark)
    results = passed(spark, docs, str(tmp_path))
    assert all(df.columns == docs.columns for df in results[:-1])
    assert all(r.lang_pred == "other" and r["size"] == "other" for df in results[:-1] for r in df.collect())
    assert passed(spark, odd.nothing(spark), str(tmp_path))[-1].count() == 0


def test_mixed_texts_of_odd_documents(spark):
    docs = odd.documents(spark)
    _, taken = mixing.mix(docs)
    rows = mixing.mixed_texts(docs, taken)
    assert rows.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in rows.collect()) == taken.agg({"words": "sum"}).first()[0]
