from collections import Counter

import numpy as np
import odd

from tabletop.llm import lm_scoring as L


def test_odd_rows(spark):
    docs = odd.documents(spark)
    model = L.train(docs, stride=2)
    rows = L.score(docs, model).collect()
    assert len(rows) == len(odd.ROWS) and {row.score for row in rows} == {"other"}
    for row in rows:
        words = len((row.text or "").split())
        assert row.n_words == words and np.isfinite(row.log_prob) and (row.log_prob < 0) == (words > 0)
        assert np.isclose(row.mean_log_prob * max(1, words), row.log_prob)
    model = L.train(odd.nothing(spark))
    assert L.score(odd.nothing(spark), model).count() == 0
    assert L.score_texts(["never seen", None], model)[0].tolist() == [2, 0]


def test_counts(spark):
    docs = spark.createDataFrame([("A a b",), (None,), ("",), ("b c",)], "text string")
    assert sorted(map(tuple, L.word_counts(docs).collect())) == [
        ("a", L.ending("a"), 2), ("b", L.ending("b"), 2), ("c", L.ending("c"), 1)]


def test_training_helps_and_sides_matter(spark):
    """Words follow a fixed round: a trained network knows each from its neighbours, out of order it does not."""
    text = " ".join(["red", "fox", "sees", "old", "house", "near", "green", "hill"] * 200)
    docs = spark.createDataFrame([(i, text) for i in range(24)], "doc_id bigint, text string").repartition(4)
    plain = L.initial(L.word_counts(docs), classes=8)
    model = plain
    for number in range(2):
        model = L.learn_round(docs, model, number, 1)
    words = text.split()
    shuffled = " ".join(sorted(words))
    (_, before), (_, after) = L.score_texts([text], plain), L.score_texts([text, shuffled], model)
    assert after[0] > before[0] / 2 and after[0] > after[1] / 2


def test_gradient():
    """The step against differences of the loss."""
    random = np.random.default_rng(0)
    shapes = [(12, L.EMBEDDING), (2 * L.SIDE * L.EMBEDDING, L.HIDDEN), (L.HIDDEN,), (L.HIDDEN, 7), (7,)]
    layers = [random.normal(0, 0.3, shape) for shape in shapes]
    context, target = random.integers(0, 12, (30, 2 * L.SIDE)), random.integers(0, 7, 30)
    loss = lambda given: -L._forward(given, context)[2][np.arange(30), target].mean()
    moved = [layer.copy() for layer in layers]
    L._learn(moved, context, target, 1e-6)
    for layer, after in zip(layers, moved):
        at = tuple(random.integers(0, n) for n in layer.shape)
        before = layer[at]
        layer[at] = before + 1e-5
        high = loss(layers)
        layer[at] = before - 1e-5
        low = loss(layers)
        layer[at] = before
        assert np.isclose((before - after[at]) / 1e-6, (high - low) / 2e-5, atol=1e-5)


def test_every_position_is_a_target_once(spark, monkeypatch):
    """Also in texts of a few words and in many small partitions, with what the registered query trains by."""
    texts = ["a b c", "d", "e f g h i j k l m n o p q r s t u v w x", "", None]
    docs = spark.createDataFrame([(text,) for text in texts * 6], "text string").repartition(9)
    words, seen = sum(len((text or "").split()) for text in texts) * 6, []
    collect = type(docs).collect

    def watched(df):
        rows = collect(df)
        if "seen" in df.columns:
            seen.append(rows[0].seen)
        return rows

    monkeypatch.setattr(type(docs), "collect", watched)
    L.train(docs)
    assert sum(seen) == words and len(seen) == L.ROUNDS


def test_words_that_are_not_frequent_have_their_shares(spark):
    """Of two such words of one ending the commoner scores higher by the ratio of counts; all words and one not met sum up to 1."""
    words = {"the": 50, "xqing": 12, "yqing": 3, "zqing": 1, "of": 40, "a": 30}
    docs = spark.createDataFrame([(" ".join([word] * n),) for word, n in words.items()], "text string")
    model = L.initial(L.word_counts(docs), vocabulary=3)
    assert set(model.ids) == {"the", "of", "a"}
    every = [*words, "neverqing"]
    rows = {row.text: row.log_prob for row in L.score(spark.createDataFrame([(word,) for word in every], "text string"), model).collect()}
    assert np.isclose(rows["xqing"] - rows["zqing"], np.log(12)) and np.isclose(rows["yqing"] - rows["zqing"], np.log(3))
    assert np.isclose(rows["neverqing"], rows["zqing"])
    layers = model.layers(model.weights)
    mark = len(model.word_class)
    _, hidden, log_prob = L._forward(layers, np.full((1, 2 * L.SIDE), mark))
    ids = np.arange(mark)
    ways = model.ways(ids)
    lean = L._lean(layers, np.repeat(hidden, mark, 0), ways)
    each = log_prob[0, model.word_class] - np.bincount(ways[0], np.logaddexp(0, -lean), mark)
    assert np.isclose(np.exp(each).sum(), np.exp(log_prob[0, np.unique(model.word_class)]).sum(), atol=1e-4)
    assert np.isclose(sum(np.exp(rows[word]) for word in every if word.endswith("qing")), np.exp(each[L.ending("xqing")]), rtol=1e-4)


def test_word_in_its_class_follows_from_the_context(spark):
    """One class holds all frequent words, so only the way inside it can tell them apart."""
    text = " ".join(["red", "fox", "sees", "old", "house", "near", "green", "hill"] * 200)
    docs = spark.createDataFrame([(i, text) for i in range(24)], "doc_id bigint, text string").repartition(4)
    plain = model = L.initial(L.word_counts(docs), classes=1)
    for number in range(2):
        model = L.learn_round(docs, model, number, 1)
    (_, before), (_, after) = L.score_texts([text], plain), L.score_texts([text], model)
    assert after[0] > before[0] / 2


def test_gradient_of_ways():
    random = np.random.default_rng(1)
    shapes = [(12, L.EMBEDDING), (2 * L.SIDE * L.EMBEDDING, L.HIDDEN), (L.HIDDEN,), (L.HIDDEN, 7), (7,), (9, L.HIDDEN), (9,)]
    layers = [random.normal(0, 0.3, shape) for shape in shapes]
    context, target = random.integers(0, 12, (30, 2 * L.SIDE)), random.integers(0, 7, 30)
    ways = (np.sort(random.integers(0, 30, 80)), random.integers(0, 9, 80), random.choice([-1.0, 1.0], 80))

    def loss(given):
        _, hidden, log_prob = L._forward(given, context)
        return (np.logaddexp(0, -L._lean(given, hidden, ways)).sum() - log_prob[np.arange(30), target].sum()) / 30

    moved = [layer.copy() for layer in layers]
    L._learn(moved, context, target, 1e-6, ways)
    for layer, after in zip(layers, moved):
        for _ in range(5):
            at = tuple(random.integers(0, n) for n in layer.shape)
            before = layer[at]
            layer[at] = before + 1e-5
            high = loss(layers)
            layer[at] = before - 1e-5
            low = loss(layers)
            layer[at] = before
            assert np.isclose((before - after[at]) / 1e-6, (high - low) / 2e-5, atol=1e-5)


def test_words_are_numbered_once(spark):
    """Two passes over the texts, for counts and for numbers, serve all rounds and the scores, which are those of the separate calls."""
    read = spark.sparkContext.accumulator(0)

    def watched(frames):
        for frame in frames:
            read.add(frame.num_rows)
            yield frame

    given = odd.documents(spark).coalesce(1)
    rows = L.train_and_score(given.mapInArrow(watched, given.schema)).collect()
    assert read.value == 2 * len(odd.ROWS)
    apart = L.score(given, L.train(given)).collect()
    key = lambda row: (str(row.text), row.n_words, row.log_prob)
    assert len(rows) == len(apart) == len(odd.ROWS)
    for one, other in zip(sorted(rows, key=key), sorted(apart, key=key)):
        assert one.text == other.text and one.n_words == other.n_words and np.isclose(one.log_prob, other.log_prob)


def test_known_and_joined_shares_agree(spark, monkeypatch):
    """Whether all tasks know the count of a word or it is joined; and words are those that Python tells."""
    texts = [" ".join([word] * n) for word, n in {"the": 50, "xqing": 12, "yqing": 3, "zqing": 1, "of": 40}.items()]
    texts += ["\u0130x  \u03a3\u0391\u03a3\x1cend\x85of\u3000the\ta\xa0b", "   ", "", None, "ab ab \U0001f600\U0001f600\U0001f600\U0001f600 ab", "of xqing yqing yqing"]
    docs = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "i int, text string").coalesce(1)
    counted = Counter(word for text in texts for word in (text or "").lower().split())
    assert {row.word: (row.ending, row.n) for row in L.word_counts(docs).collect()} == {
        word: (L.ending(word), n) for word, n in counted.items()}
    found = []
    for known in (0, 2, 1000):
        monkeypatch.setattr(L, "_KNOWN", known)
        model = L.initial(L.word_counts(docs), vocabulary=3)
        assert len(model.known) <= known and (known < 1000 or len(model.known) == len(counted) - 3)
        found.append([tuple(row) for row in L.score(docs, model).orderBy("i").select("n_words", "log_prob").collect()])
    assert [row[0] for row in found[0]] == [len((text or "").split()) for text in texts]
    for other in found[1:]:
        assert np.allclose(found[0], other)
    counts, sums = L.score_texts(texts, model)
    for (n, log_prob), text, plain in zip(found[0], texts, sums):
        shares = sum(np.log(counted[word]) for word in (text or "").lower().split() if word not in model.ids)
        assert np.isclose(log_prob, plain + shares)


def test_many_words_are_counted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(L, "_COUNTED_WORDS", 3)
    monkeypatch.setattr(L, "_COUNTED_CHARS", 10)
    texts = ["a b c d e", "a a b f g", None, "h i j k l m n o p q a"] * 3
    docs = spark.createDataFrame([(text,) for text in texts], "text string").coalesce(1)
    counted = Counter(word for text in texts for word in (text or "").split())
    assert {row.word: row.n for row in L.word_counts(docs).collect()} == counted


def test_rows_are_added_at_repeated_places():
    random = np.random.default_rng(3)
    for index in (np.array([0, 1, 2, 0, 1, 0, 3, 3, 5]), np.zeros(0, int), random.integers(0, 6, 40)):
        values = random.normal(size=(len(index), 4)).astype(np.float32)
        added, taken = np.zeros((6, 4), np.float32), np.zeros((6, 4), np.float32)
        plain = np.zeros((6, 4))
        np.add.at(plain, index, values)
        L._add_runs(added, index, values)
        L._subtract(taken, index, values)
        assert np.allclose(added, plain, atol=1e-5) and np.allclose(taken, -plain, atol=1e-5)
