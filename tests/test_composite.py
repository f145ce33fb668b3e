"""Keys and references of several columns against brute force."""

import random
from itertools import combinations, permutations

import pytest
from conftest import plan_of, values
from pyspark.sql import functions as F

from tabletop.operators import composite
from tabletop.operators.composite import check_composite_reference, discover_composite_references, minimal_keys


def brute_keys(rows, names, width):
    found = []
    solid = [i for i in range(len(names)) if all(row[i] is not None for row in rows)]
    for k in range(1, width + 1):
        for some in combinations(solid, k):
            if not any(set(key) <= set(some) for key in found) and len({tuple(row[i] for i in some) for row in rows}) == len(rows):
                found.append(some)
    return [tuple(names[i] for i in some) for some in found]


def test_minimal_keys_against_brute_force(spark):
    random.seed(4)
    frames, expected = {}, {}
    for number, (letters, columns, count) in enumerate([(5, 6, 25), (5, 6, 40), (40, 4, 120)]):
        names = [f"c{i}.x" for i in range(columns)]
        rows = list({tuple(random.randrange(letters) for _ in names) for _ in range(count)})
        rows = [(*row[:-1], None if number == 1 and i == 3 else row[-1]) for i, row in enumerate(rows)]
        name = f"t{number}"
        frames[name] = spark.createDataFrame(rows, ", ".join(f"`{n}` int" for n in names))
        expected[name] = brute_keys(rows, names, 4)
    frames["empty"] = frames["t0"].limit(0)
    found = minimal_keys(frames)
    assert {name: sorted(keys) for name, keys in found.items()} == {**{n: sorted(k) for n, k in expected.items()}, "empty": []}
    assert {len(key) for some in expected.values() for key in some} >= {3, 4}


def test_key_of_three_columns(spark):
    grid = spark.range(40 * 30 * 20).select(
        (F.col("id") % 40).alias("shop"), (F.floor(F.col("id") / 40) % 30).alias("day"), F.floor(F.col("id") / 1200).alias("item"),
        F.lit("same").alias("kind"), F.array(F.col("id")).alias("list"))
    assert minimal_keys({"grid": grid}) == {"grid": [("shop", "day", "item")]}
    assert minimal_keys({"grid": grid}, 2) == {"grid": []}
    twice = grid.union(grid.limit(1))
    assert minimal_keys({"grid": twice}) == {"grid": []}
    with pytest.raises(ValueError):
        minimal_keys({"grid": grid}, 0)


def test_parts_of_keys_and_columns_without_order(spark, monkeypatch):
    df = spark.range(900).select((F.col("id") % 30).alias("a"), F.floor(F.col("id") / 30).alias("b"), (F.col("id") % 7).alias("c"), F.lit(1).alias("d"))
    frames = {"t": df, "lists": df.select(F.array("a").alias("x"))}
    expected = {"t": [("a", "b")], "lists": [], "hot": []}
    frames["hot"] = df.union(df.where("a = 5 and b = 5"))
    assert minimal_keys(frames) == expected
    monkeypatch.setattr(composite, "_SHARES", (2, 1))
    monkeypatch.setattr(composite, "_DIGESTS_A_PASS", 1)
    assert minimal_keys(frames) == expected


def test_what_nearly_is_a_key_meets_on_all_rows_once(spark, monkeypatch):
    """Wider combinations are told on the rows that repeat a part of them."""
    again = F.col("id") >= 19500
    df = spark.range(20000).select((F.col("id") % 19500).alias("a"), *[
        F.when(~again | (F.floor(F.col("id") % 19500 / 2) == i), 0).otherwise(1).alias(f"b{i}") for i in range(5)])
    checked, whole = [], composite._Lattice._whole
    monkeypatch.setattr(composite._Lattice, "_whole", lambda self, wanted: (checked.extend(wanted), whole(self, wanted))[1])
    assert minimal_keys({"t": df}) == {"t": [("a", f"b{i}", f"b{j}") for i in range(5) for j in range(i + 1, 5)]}
    assert checked == [("t", ("a",))]


def brute_references(data, keys):
    found = []
    for child, (names, rows) in data.items():
        for parent, some in keys.items():
            for key in some:
                if child == parent or len(key) < 2:
                    continue
                places = [data[parent][0].index(column) for column in key]
                held = {tuple(row[i] for i in places) for row in data[parent][1]}
                singles = [{row[i] for row in data[parent][1]} for i in places]
                for columns in permutations(range(len(names)), len(key)):
                    own = [tuple(row[i] for i in columns) for row in rows]
                    own = [row for row in own if None not in row]
                    unary = all({row[i] for row in rows if row[i] is not None} <= single for i, single in zip(columns, singles))
                    if own and unary and set(own) <= held:
                        found.append((child, [names[i] for i in columns], parent, list(key), len(own)))
    return sorted(found)


def test_references_against_brute_force(spark):
    random.seed(6)
    parent = [(i, chr(97 + j), i * j) for i in range(8) for j in range(4) if (i + j) % 5]
    child = [(*random.choice(parent)[:2], random.randrange(8)) for _ in range(90)] + [(3, None, 1), (None, "a", 2)]
    child += [(1, "b", 2)] * 300
    stray = [(0, "a", 5), (4, "b", 4)]
    data = {"p": (["k", "s", "v"], parent), "c": (["x", "y", "z"], child), "s": (["x", "y", "z"], stray), "q": (["m", "n", "o"], [(1, "b", 2)])}
    types = {"p": "k int, s string, v bigint", "c": "x bigint, y string, z int", "s": "x smallint, y string, z decimal(9,0)", "q": "m int, n string, o int"}
    frames = {}
    for name, (_, rows) in data.items():
        frame = spark.createDataFrame(rows, types[name].replace("smallint", "int").replace("decimal(9,0)", "int"))
        frames[name] = frame.withColumn("x", F.col("x").cast("smallint")).withColumn("z", F.col("z").cast("decimal(9,0)")) if name == "s" else frame
    keys = {"p": [("k", "s"), ("k", "s", "v"), ("v",)], "c": [("x", "y")], "q": []}
    found = sorted(map(tuple, discover_composite_references(frames, keys).collect()))
    expected = brute_references({n: d for n, d in data.items()}, keys)
    assert found == expected and ("c", ["x", "y"], "p", ["k", "s"], 390) in found and not any(row[0] == "s" for row in found if row[2] == "p")
    assert discover_composite_references(frames, {"p": [("k",)]}).collect() == []


def test_check_reference_of_two_columns(spark):
    parent = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a")], "k int, s string")
    child = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "b"), (3, "a"), (None, "a"), (1, None)], "x int, y string")
    found = check_composite_reference(child, ["x", "y"], parent, ["k", "s"])
    assert values(found) == [(5, 3, 2)]
    assert values(check_composite_reference(child.limit(0), ["x"], parent, ["k"])) == [(0, 0, 0)]
    assert "CartesianProduct" not in plan_of(found) and "NestedLoop" not in plan_of(found.where("child_rows > 9"))
    with pytest.raises(ValueError):
        check_composite_reference(child, ["x", "y"], parent, ["k"])
