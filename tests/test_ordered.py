import random

import pytest
from conftest import plan_of, values

from tabletop.operators.ordered import group_sample, with_global_ranks


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_ranks_against_brute_force(spark, ranges):
    random.seed(ranges)
    rows = [(i, random.choice([None, 7, 7, 7, *range(40)]), random.choice([None, 1, 5])) for i in range(400)]
    found = with_global_ranks(spark.createDataFrame(rows, "id int, v int, w bigint").selectExpr("*", "'x' AS rank"), "v", "w", ranges)
    last = lambda v: (v is None, v or 0)
    different = sorted({v for _, v, _ in rows}, key=last)
    expected = []
    for i, v, w in rows:
        smaller = sum(last(o) < last(v) for _, o, _ in rows)
        upto = [x or 0 for _, o, x in rows if last(o) <= last(v)]
        expected.append((i, v, w, smaller + 1, different.index(v) + 1, smaller / 399, len(upto) / 400, sum(upto)))
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert [c for c in found.columns] == ["id", "v", "w", "rank", "dense_rank", "percent_rank", "cume_dist", "running_total"]


def test_ranks_of_few_rows(spark):
    one = spark.createDataFrame([("a",)], "s string")
    assert values(with_global_ranks(one, "s")) == [("a", 1, 1, 0.0, 1.0)]
    assert with_global_ranks(one.limit(0), "s").count() == 0


def test_sample_is_exact_and_the_same(spark):
    rows = [(i, "hot" if i % 3 else f"g{i % 5}") for i in range(500)] + [(900, None), (None, None)]
    df = spark.createDataFrame(rows, "id int, g string")
    found = group_sample(df, ["g"], 7, "id")
    sizes = {row.g: row["count"] for row in found.groupBy("g").count().collect()}
    assert sizes == {"hot": 7, None: 2, **{f"g{k}": 7 for k in range(5)}}
    assert values(found) == values(group_sample(df.repartition(3), ["g"], 7, "id"))
    assert "WindowGroupLimit" in plan_of(found) and values(group_sample(df, ["g"], 1000, "id")) == values(df)
