"""Sums over pairs that are never made, against all pairs."""

import operator
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from conftest import values
from pyspark.sql import functions as F

from tabletop.operators import overlap_counts, theta_sums
from tabletop.plans import registry

HOLDS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


@pytest.mark.parametrize("signs", [("<", ">="), ("<=", "<"), (">=", "<="), (">", ">")])
def test_theta_sums_against_all_pairs(spark, signs):
    """Ties, a value that a third of the rows hold, repeated rows, nulls, and times of fractions of seconds."""
    source = random.Random(4)

    def rows(n):
        found = []
        for i in range(n):
            x = 40 if source.random() < 0.33 else source.choice([source.randint(0, 90), source.randint(0, 9), None])
            found.append((i // 2, x, datetime(2020, 1, 1) + timedelta(microseconds=source.randint(0, 30) * 300_000) if i % 17 else None))
        return found + found[:5]

    left, right = rows(200), rows(120)
    a = spark.createDataFrame(left, "a bigint, ax bigint, ay timestamp_ntz").repartition(3)
    b = spark.createDataFrame([(i, None if x is None else float(x), y) for i, x, y in right], "b bigint, bx double, `b y` timestamp_ntz")
    found = theta_sums(a, b, ("ax", signs[0], "bx"), ("ay", signs[1], "b y"), ["a", "ax"])
    assert found.columns == ["b", "bx", "b y", "matches", "most_a", "most_ax"]
    expected = Counter()
    for q in right:
        met = [p for p in left if None not in (*p, *q) and HOLDS[signs[0]](p[1], q[1]) and HOLDS[signs[1]](p[2], q[2])]
        if met:
            expected[*q, len(met), max(p[0] for p in met), max(p[1] for p in met)] += 1
    assert Counter(map(tuple, found.collect())) == expected and expected


def test_theta_sums_of_odd_tables(spark):
    some = spark.createDataFrame([(1, 2.0), (2, float("nan")), (None, 1.0)], "a int, ax double")
    other = spark.createDataFrame([(0, 5.0), (7, float("nan"))], "b int, bx double")
    found = theta_sums(some, other, ("a", "<", "b"), ("ax", "<=", "bx"), ["a"]).select("b", "matches", "most_a")
    assert values(found) == [(7, 2, 2)]
    assert theta_sums(some, other.limit(0), ("a", "<", "b"), ("ax", "<", "bx")).columns == ["b", "bx", "matches"]
    assert theta_sums(some.limit(0), other, ("a", "<", "b"), ("ax", "<", "bx"), ["ax"]).count() == 0
    with pytest.raises(ValueError, match="not an inequality"):
        theta_sums(some, other, ("a", "<", "b"), ("ax", "=", "bx"))


def test_more_pairs_than_could_be_made(spark):
    n = 200_000
    left = spark.range(n).selectExpr("id AS a", "id % 1000 AS x")
    right = spark.range(n).selectExpr("id AS b", "-1 AS y")
    found = theta_sums(left, right, ("a", "<", "b"), ("x", ">", "y"), ["a"])
    assert found.agg(F.sum("matches"), F.sum(F.col("b") - F.col("most_a"))).first()[:] == (n * (n - 1) // 2, n - 1)
    ends = left.selectExpr("x % 2 AS odd", "a AS s", "a + 100000 AS e"), right.selectExpr("b", "b + 1 AS c")
    counted = overlap_counts(*ends, ("s", "e"), ("b", "c"), "odd")
    pairs = sum(min(b, n - 1) - max(0, b - 99_999) + 1 for b in range(n))
    assert counted.agg(F.sum("matches")).first()[0] == pairs and counted.select("odd").distinct().count() == 2


def test_overlap_counts_against_brute_force(spark):
    random.seed(5)

    def some(count):
        rows = []
        for i in range(count):
            start = random.choice([random.uniform(-500, 500), float(random.randrange(-20, 20)), 3.0])
            rows.append((i % 50, start, start + random.choice([0.0, 0.5, 1.0, 30.0, 700.0, 1e6, -4.0]), random.choice(["u", "v", None])))
        return rows + [(count, None, 5.0, "u"), (count + 1, 1.0, None, "w"), (0, 1.0, 2.0, "u"), (0, 1.0, 2.0, "u")]

    left, right = some(120), some(90)
    p = spark.createDataFrame(left, "p int, a double, b double, k string")
    q = spark.createDataFrame(right, "q int, c double, d double, m string")
    found = overlap_counts(p, q, ("a", "b"), ("c", "d"), "k")
    assert found.columns == ["k", "q", "c", "d", "m", "matches"]
    expected = Counter()
    for row in right:
        met = Counter(x[3] for x in left if None not in (*x[1:3], *row[1:3]) and x[1] < x[2] and row[1] < row[2] and x[1] < row[2] and row[1] < x[2])
        for k, n in met.items():
            expected[k, *row, n] += 1
    assert Counter(map(tuple, found.collect())) == expected
    assert overlap_counts(p, q.limit(0), ("a", "b"), ("c", "d"), "k").count() == 0
    with pytest.raises(ValueError, match="columns named"):
        overlap_counts(p, q.withColumnRenamed("q", "K"), ("a", "b"), ("c", "d"), "k")


def test_queries_make_no_pairs(spark, small):
    for name in ("d6_theta_rows", "d7_overlap_join_numbers"):
        plan = registry.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert "matches" in plan, name
