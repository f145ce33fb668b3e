import numpy as np
import odd

from tabletop.llm import language_id as L


def test_odd_rows(spark):
    docs = odd.documents(spark)
    model = L.train(docs)
    assert model.languages == ("de", "en", "es")
    rows = L.identify(docs, model).select("doc_id", "text", "lang_pred", "lang_score", "score").collect()
    assert len(rows) == len(odd.ROWS) and {row.score for row in rows} == {"other"}
    for row in rows:
        lettered = any(char.isalpha() for char in row.text or "")
        assert (row.lang_pred == "und") == (not lettered) and 0 <= row.lang_score <= 1
    told = {row.doc_id: row.lang_pred for row in rows}
    assert told[1] == told[8] == "en" and told[3] == "de" and told[12] == "es"


def test_empty_table(spark):
    model = L.train(odd.nothing(spark))
    assert model.languages == () and L.identify(odd.nothing(spark), model).count() == 0
    only = L.identify(odd.documents(spark), model).select("lang_pred", "lang_score").distinct().collect()
    assert [tuple(row) for row in only] == [("und", 0.0)]


def test_counts_are_those_of_plain_code(monkeypatch):
    """Long texts in slices give the same n-grams as in one piece, and batches the same as single texts."""
    text = "Ab, c--d 12 eé\n" * 40
    whole = [np.sort(np.concatenate([b for _, b in L._grams([text])]))]
    monkeypatch.setattr(L, "_SLICE", 37)
    sliced = np.sort(np.concatenate([b for _, b in L._grams([text])]))
    assert (whole[0] == sliced).all()
    together = np.concatenate([b[r == 1] for r, b in L._grams(["xyz", text, "q"])])
    assert (np.sort(together) == sliced).all()


def test_scores_are_the_posterior(spark):
    """Against naive Bayes written out over dictionaries of n-grams."""
    docs = [("en", "the cat"), ("en", "a dog the"), ("fr", "le chat de la")]
    model = L.train(spark.createDataFrame(docs, "lang string, text string"))
    langs, scores = L.score_texts(["the chat"], model)
    total = []
    for column in range(2):
        grams = np.concatenate([b for _, b in L._grams(["the chat"])])
        total.append(model.log_prior[column] + model.log_prob[grams, column].sum())
    assert langs == [model.languages[int(np.argmax(total))]]
    assert np.isclose(scores[0], 1 / np.exp(np.array(total) - max(total)).sum())
    assert np.allclose(np.exp(model.log_prob).sum(axis=0), 1)


def test_held_out_accuracy(spark, small):
    from tabletop.llm.queries import op1_language_id

    found = op1_language_id(spark, small)
    known = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang")
    rows = found.join(known, "doc_id").where("held_out").collect()
    assert rows and sum(row.lang == row.lang_pred for row in rows) >= 0.95 * len(rows)
