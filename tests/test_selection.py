import math
import random

import numpy as np
import pytest

from tabletop.operators import selection
from tabletop.operators.selection import exact_percentiles

FRACTIONS = [0.0, 0.01, 0.5, 0.73, 1.0]


def table(spark, rows=4000):
    random.seed(5)
    data = [(random.choice(["a", "a", "a", "b", None]), random.choice([random.gauss(0, 1e4), 7.0, -0.5])) for _ in range(rows)]
    data += [("c", 1.5), ("d", None), ("d", float("nan")), ("e", 1.0), ("e", 2.0), ("e", None), ("f", math.inf), ("f", math.inf)]
    return spark.createDataFrame(data, "g string, x double"), data


def expected(data):
    groups = {}
    for g, x in data:
        if x is not None and not math.isnan(x):
            groups.setdefault(g, []).append(x)
    return {(g, f): (len(xs), math.inf if g == "f" else np.quantile(xs, f)) for g, xs in groups.items() for f in FRACTIONS}


@pytest.mark.parametrize("accuracy, ranges", [(10_000, 7), (20, 200), (20, 1)])
def test_against_brute_force(spark, accuracy, ranges):
    df, data = table(spark)
    found = exact_percentiles(df.withColumn("rows", df.g), ["g"], "x", FRACTIONS, accuracy, ranges).collect()
    want = expected(data)
    assert len(found) == len(want)
    for g, f, n, value in found:
        assert (n, value) == (want[g, f][0], pytest.approx(want[g, f][1], rel=1e-12))


def test_brackets_that_miss_are_counted_again(spark, monkeypatch):
    df, data = table(spark, 500)
    honest = selection._bracketed
    calls = []

    def shifted(rows, bounds):
        calls.append(1)
        if len(calls) == 1:
            bounds = bounds.withColumns({"_low": bounds._low + 5000, "_high": bounds._high + 5000})
        return honest(rows, bounds)

    monkeypatch.setattr(selection, "_bracketed", shifted)
    found = exact_percentiles(df, ["g"], "x", FRACTIONS).collect()
    assert len(calls) == 2 and len(found) == len(expected(data))
    for g, f, n, value in found:
        assert (n, value) == (expected(data)[g, f][0], pytest.approx(expected(data)[g, f][1], rel=1e-12))


def test_whole_table_and_empty_one(spark):
    df = spark.range(1001).selectExpr("id * id AS id")
    assert [tuple(row) for row in exact_percentiles(df, [], "id", [0.5]).collect()] == [(0.5, 1001, 250000.0)]
    assert exact_percentiles(df.where("id < 0"), [], "id", [0.5]).collect() == []
    with pytest.raises(ValueError):
        exact_percentiles(df, [], "id", [1.5])
