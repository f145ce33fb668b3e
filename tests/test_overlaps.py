import datetime
import random

import pytest
from conftest import plan_of, values

from tabletop.operators.overlaps import overlap_join


def brute(left, right, keyed):
    return sorted((p[0], q[0]) for p in left for q in right
                  if None not in (*p[1:3], *q[1:3]) and p[1] < p[2] and q[1] < q[2] and p[1] < q[2] and q[1] < p[2]
                  and (not keyed or (p[3] is not None and p[3] == q[3])))


@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("grain", [1, 7.5, 5000])
def test_numbers_against_brute_force(spark, grain, keyed):
    random.seed(int(grain))
    def some(count):
        rows = []
        for i in range(count):
            start = random.choice([random.uniform(-500, 500), float(random.randrange(-20, 20)), 3.0])
            rows.append((i, start, start + random.choice([0.0, 0.5, 1.0, 30.0, 700.0, 1e6, -4.0]), random.choice([1, 2, None])))
        return rows + [(count, None, 5.0, 1), (count + 1, 1.0, None, 1), (0, 1.0, 2.0, 1), (0, 1.0, 2.0, 1)]
    left, right = some(120), some(90)
    p = spark.createDataFrame(left, "p int, a double, b double, k int")
    q = spark.createDataFrame(right, "q int, c double, d double, m int")
    found = overlap_join(p, q, ("a", "b"), ("c", "d"), grain, [("k", "m")] if keyed else [])
    assert found.columns == ["p", "a", "b", "k", "q", "c", "d", "m"]
    assert values(found.select("p", "q")) == sorted(brute(left, right, keyed), key=repr)
    plan = plan_of(found)
    assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.count("Join") == 1


def test_times(spark):
    random.seed(2)
    at = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=n)
    def some(count):
        starts = [random.randrange(0, 4_000_000) for _ in range(count)]
        return [(i, at(s), at(s + random.choice([1, 3600, 90_000, 9_000_000]))) for i, s in enumerate(starts)]
    left, right = some(100), [*some(80), (99, datetime.datetime(1900, 1, 1), datetime.datetime(9999, 1, 1))]
    p = spark.createDataFrame(left, "p int, a timestamp_ntz, b timestamp_ntz")
    q = spark.createDataFrame(right, "q int, c timestamp_ntz, d timestamp_ntz")
    for grain in ("hour", "week"):
        found = overlap_join(p, q, ("a", "b"), ("c", "d"), grain).select("p", "q")
        assert values(found) == sorted(brute(left, right, False), key=repr)
    assert overlap_join(p, q.limit(0), ("a", "b"), ("c", "d")).count() == 0
    with pytest.raises(ValueError, match="columns named"):
        overlap_join(p, q.withColumnRenamed("q", "P"), ("a", "b"), ("c", "d"))
    with pytest.raises(ValueError, match="grain"):
        overlap_join(p, q, ("a", "b"), ("c", "d"), 0)


def test_short_intervals_do_not_meet_on_levels_of_long_ones(spark):
    """One interval over everything on both sides: 40,000 short ones each would make 1.6 billion pairs there, of which none is one."""
    n = 40_000
    p = spark.range(n).selectExpr("id AS p", "IF(id = 0, 0, id * 3) * 1D AS a", "IF(id = 0, 3 * 40000, id * 3 + 2) * 1D AS b")
    q = spark.range(n).selectExpr("id AS q", "IF(id = 0, 0, id * 3 + 1) * 1D AS c", "IF(id = 0, 3 * 40000, id * 3 + 2) * 1D AS d")
    found = overlap_join(p, q, ("a", "b"), ("c", "d"), 1)
    assert found.count() == 3 * (n - 1) + 1
    keys = next(line for line in plan_of(found).splitlines() if "Join" in line)
    assert "_lshort" in keys
