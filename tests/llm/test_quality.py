import numpy as np
import odd
from pyspark.sql import functions as F

from tabletop.llm import quality as Q
from tabletop.llm.queries import op5_quality


def test_odd_rows(spark):
    docs = Q.with_statistics(odd.documents(spark))
    rows = docs.select("text", "statistics", "score").collect()
    assert len(rows) == len(odd.ROWS) and all(np.isfinite(list(row.statistics)).all() for row in rows)
    assert {tuple(r.statistics) for r in rows if not r.text} == {Q.text_statistics("")}
    rules = Q.train(docs.withColumn("label", F.when(F.col("doc_id") < 6, 1).otherwise(0)))
    scored = docs.select(rules.score().alias("p")).collect()
    assert all(0 <= row.p <= 1 for row in scored)


def test_nothing_to_learn(spark):
    docs = Q.with_statistics(odd.documents(spark))
    for label, score in ((None, 0.5), (7, 0.5), (1, 1.0), (0, 0.0)):
        rules = Q.train(docs.withColumn("label", F.lit(label).cast("int")))
        assert {round(row.p, 6) for row in docs.select(rules.score().alias("p")).collect()} == {score}
    assert Q.with_statistics(odd.nothing(spark)).count() == 0


def test_columns_score_like_numpy(spark):
    random = np.random.default_rng(3)
    rows = random.random((400, len(Q.STATISTICS)))
    labels = ((rows[:, 3] > 0.5) & (rows[:, 7] <= 0.4)).astype(float)
    rules = Q.fit_rules(rows, labels)
    odds = rules.intercept + sum(w * r.holds(rows) for r, w in zip(rules.rules, rules.weights))
    assert ((odds > 0) == labels).mean() > 0.97 and 0 < len(rules.rules) < 100
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(rows)], ["i", *Q.STATISTICS])
    df = df.select("i", F.struct(*Q.STATISTICS).alias("statistics")).select("i", rules.score().alias("p"))
    found = np.array([row.p for row in df.orderBy("i").collect()])
    assert np.allclose(found, 1 / (1 + np.exp(-odds)))


def test_held_out(spark, small):
    rows = op5_quality(spark, small)
    labels = spark.read.parquet(f"{small}/labels.parquet")
    known = rows.join(labels, "doc_id").where("held_out").collect()
    assert known and sum(row.predicted == row.quality for row in known) >= 0.85 * len(known)
    assert all(row.predicted == (row.score >= 0.5) for row in known)


def test_copies_take_one_place_and_count_by_number(spark, monkeypatch):
    random = np.random.default_rng(4)
    rows = random.random((60, len(Q.STATISTICS)))
    labels = (rows[:, 3] > 0.5).astype(float)
    copies = random.integers(1, 9, 60)
    whole = Q.fit_rules(np.repeat(rows, copies, 0), np.repeat(labels, copies))
    short = Q.fit_rules(rows, labels, copies=copies.astype(float))
    assert short.rules == whole.rules and np.allclose(short.weights, whole.weights) and np.isclose(short.intercept, whole.intercept)
    seen = []
    monkeypatch.setattr(Q, "fit_rules", lambda *given, **more: seen.append((given, more)))
    table = [(i % 2, *map(float, row)) for i, row in enumerate(rows[:12]) for _ in range(40)]
    df = spark.createDataFrame(table, ["label", *Q.STATISTICS]).select("label", F.struct(*Q.STATISTICS).alias("statistics"))
    Q.train(df, max_rows=12)
    (given, more), = seen
    assert len(np.unique(given[0], axis=0)) == 12 and set(more["copies"]) == {40.0}
