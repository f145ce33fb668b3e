import random

from conftest import values

from tabletop.operators.reach import reachable


def brute(links, starts):
    found = set()
    for start in {s for s in starts if s is not None}:
        steps, layer = {start: 0}, [start]
        while layer:
            layer = [b for a in layer for f, b in links if f == a and b is not None and b not in steps and not steps.update({b: steps[a] + 1})]
        found |= {(start, node, n) for node, n in steps.items()}
    return sorted(found, key=repr)


def test_against_brute_force(spark):
    random.seed(3)
    links = [(random.randrange(40), random.randrange(40)) for _ in range(50)]
    links += [(100 + i, 100 + (i + 1) % 9) for i in range(9)] + [(1, 1), (None, 3), (3, None), links[0], links[0]]
    starts = [0, 1, 5, 5, None, 104, 999]
    df = spark.createDataFrame(links, "start int, node int")
    found = reachable(df, "start", "node", spark.createDataFrame([(s,) for s in starts], "s int"))
    assert found.columns == ["start", "node", "steps"]
    assert values(found) == brute(links, starts)


def test_nothing_to_go_on(spark):
    none = spark.createDataFrame([], "a string, b string")
    some = spark.createDataFrame([("x",)], "s string")
    assert values(reachable(none, "a", "b", some)) == [("x", "x", 0)]
    assert values(reachable(none, "a", "b", none.select("a"))) == []


def test_few_jobs_a_round(spark):
    """A round joins, compares with all known pairs, writes, and looks whether there is anything new; files are not asked for schemas."""
    links = spark.range(12).selectExpr("id AS a", "id + 1 AS b")
    starts = spark.range(1)
    spark.sparkContext.setJobGroup("reach", "rounds")
    try:
        found = reachable(links, "a", "b", starts)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("reach"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert values(found) == sorted([(0, n, n) for n in range(13)], key=repr)
    assert jobs <= 75, jobs
