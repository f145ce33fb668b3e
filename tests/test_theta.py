import operator
import random
from collections import Counter
from datetime import date, timedelta

import pytest
from conftest import plan_of

from tabletop.operators import theta_join

HOLDS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def brute(left, right, signs):
    return Counter(
        a + b for a in left for b in right
        if None not in (a[1], a[2], b[1], b[2]) and HOLDS[signs[0]](a[1], b[1]) and HOLDS[signs[1]](a[2], b[2]))


@pytest.mark.parametrize("signs", [("<", ">"), ("<=", "<"), (">=", ">="), (">", "<=")])
def test_against_all_pairs(spark, signs):
    """Ties, a value that a third of the rows hold, repeated rows, nulls, and dates."""
    source = random.Random(4)

    def rows(n):
        found = []
        for i in range(n):
            x = 40 if source.random() < 0.33 else source.choice([source.randint(0, 90), source.randint(0, 9), None])
            found.append((i // 2, x, date(2020, 1, 1) + timedelta(source.randint(0, 30)) if i % 17 else None))
        return found + found[:5]

    left, right = rows(150), rows(90)
    a = spark.createDataFrame(left, "a bigint, ax bigint, ay date").repartition(3)
    b = spark.createDataFrame([(i, None if x is None else float(x), y) for i, x, y in right], "b bigint, bx double, `b y` date")
    for ranges in (2, 16):
        met = theta_join(a, b, ("ax", signs[0], "bx"), ("ay", signs[1], "b y"), ranges)
        assert met.columns == ["a", "ax", "ay", "b", "bx", "b y"]
        assert Counter(map(tuple, met.collect())) == brute(left, right, signs)


def test_one_equality_join(spark):
    left = spark.range(3000).selectExpr("id AS a", "id % 100 AS x")
    right = spark.range(3000).selectExpr("id AS b", "id % 90 AS y")
    met = theta_join(left, right, ("a", "<", "b"), ("x", ">", "y"))
    plan = plan_of(met)
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert met.count() == sum(1 for a in range(3000) for b in range(a + 1, 3000) if a % 100 > b % 90)


def test_odd_tables(spark):
    some = spark.createDataFrame([(1, 2.0), (2, float("nan")), (None, 1.0)], "a int, ax double")
    other = spark.createDataFrame([(0, 5.0), (7, float("nan"))], "b int, bx double")
    met = theta_join(some, other, ("a", "<", "b"), ("ax", "<=", "bx")).select("a", "b").collect()
    assert sorted(map(tuple, met)) == [(1, 7), (2, 7)]
    assert theta_join(some, other.limit(0), ("a", "<", "b"), ("ax", "<", "bx")).columns == ["a", "ax", "b", "bx"]
    assert theta_join(some.limit(0), other, ("a", "<", "b"), ("ax", "<", "bx")).count() == 0
    assert theta_join(some, other, ("a", ">", "b"), ("ax", ">", "bx")).count() == 1
    with pytest.raises(ValueError, match="columns named a"):
        theta_join(some, some, ("a", "<", "a"), ("ax", "<", "ax"))
    with pytest.raises(ValueError, match="not an inequality"):
        theta_join(some, other, ("a", "<", "b"), ("ax", "=", "bx"))
