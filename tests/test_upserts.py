import glob
import os

import pytest
from conftest import values

from tabletop.operators.upserts import delete_keys, upsert
from tabletop.session import working_folder

SCHEMA = "k int, day string, amount double, note string"
ROWS = [(1, "a", 1.0, "x"), (2, "a", 2.0, None), (3, "b", 3.0, "y"), (4, "c d/e", 4.0, "z"), (5, None, 5.0, "n"), (None, "b", 6.0, "q")]


@pytest.fixture
def path(spark):
    folder = working_folder(spark, "upserts").removeprefix("file:")
    assert upsert(spark.createDataFrame(ROWS, SCHEMA), folder, ["k"], ["day"]) == 4
    return folder


def table(spark, path):
    return values(spark.read.parquet(path).select("k", "day", "amount", "note"))


def files(path):
    return {name: os.path.getmtime(name) for name in glob.glob(f"{path}/day=*/*.parquet")}


def ordered(rows):
    return sorted(rows, key=repr)


def test_changed_moved_and_new_rows(spark, path):
    before = files(path)
    changes = [(1, "a", 10.0, "new"), (3, "c d/e", 30.0, "moved"), (9, "z", 9.0, None), (None, "b", 60.0, "null key")]
    frame = spark.createDataFrame(changes, SCHEMA).select("note", "day", "k", "amount")
    assert upsert(frame, path, ["k"], ["day"]) == 4
    changed = {row[0] for row in changes}
    assert table(spark, path) == ordered([r for r in ROWS if r[0] not in changed] + changes)
    # The partition without a day has no change: its file is the one it was.
    same = [name for name in before if "__HIVE_DEFAULT_PARTITION__" in name]
    assert same and all(files(path).get(name) == before[name] for name in same)


def test_partition_that_loses_all_rows(spark, path):
    assert upsert(spark.createDataFrame([(5, "a", 5.5, "here")], SCHEMA), path, ["k"], ["day"]) == 2
    assert table(spark, path) == ordered([r for r in ROWS if r[0] != 5] + [(5, "a", 5.5, "here")])
    assert delete_keys(spark, spark.createDataFrame([(4, "odd"), (77, "")], "k int, day string"), path, ["k"], ["day"]) == 1
    assert table(spark, path) == ordered([r for r in ROWS if r[0] not in (4, 5)] + [(5, "a", 5.5, "here")])
    assert not any("c d" in name or "c%20d" in name for name in files(path))


def test_nothing_and_twice(spark, path):
    before = files(path)
    assert upsert(spark.createDataFrame([], SCHEMA), path, ["k"], ["day"]) == 0
    assert delete_keys(spark, spark.createDataFrame([(8,)], "k int"), path, ["k"], ["day"]) == 0
    with pytest.raises(ValueError):
        upsert(spark.createDataFrame([ROWS[0], ROWS[0]], SCHEMA), path, ["k"], ["day"])
    assert files(path) == before and table(spark, path) == ordered(ROWS)
