import numpy as np
import pytest

from tabletop.llm import embedding_dedup as E
from tabletop.llm.common import connected_components


def brute(vectors, threshold):
    """Links and components of (id, vector) in plain code; unsound vectors stand alone."""
    units = []
    for _, vector in vectors:
        sound = vector and None not in vector and np.isfinite(vector).all() and np.any(vector)
        scaled = np.array(vector, float) / np.abs(np.array(vector, float)).max() if sound else None
        units.append(scaled / np.linalg.norm(scaled) if sound else None)
    links, groups = [0] * len(vectors), [{i} for i in range(len(vectors))]
    for i, a in enumerate(units):
        for j, b in enumerate(units[:i]):
            if a is not None and b is not None and len(a) == len(b) and a @ b >= threshold and None not in (vectors[i][0], vectors[j][0]):
                links[i], links[j] = links[i] + 1, links[j] + 1
                joined = groups[i] | groups[j]
                for k in joined:
                    groups[k] = joined
    ids = [v[0] for v in vectors]
    least = [min((ids[k] for k in groups[i] if ids[k] is not None), default=None) for i in range(len(ids))]
    return sorted(((ids[i], links[i], least[i], ids[i] == least[i]) for i in range(len(ids))), key=repr)


def found(spark, vectors, **options):
    vectors = [(i, v and [None if x is None else float(x) for x in v]) for i, v in vectors]
    df = spark.createDataFrame([(*v, 1, "x") for v in vectors], "vec_id bigint, embedding array<double>, label int, rep string")
    return sorted(map(tuple, E.near_duplicates(df, **options).collect()), key=repr)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [1.0, 0, 0]), (2, [2.0, 0, 0]), (3, [1.0, 0.01, 0]), (3, [1.0, 0.01, 0]), (4, None), (5, []), (6, [0.0, 0, 0]),
               (7, [1.0, None, 0]), (8, [nan, 1, 1]), (9, [inf, 1, 1]), (10, [-1.0, 0, 0]), (None, [1.0, 0, 0]), (11, [1.0, 0]),
               (12, [3.0, 0]), (13, [1e300, 1e300, 0]), (14, [1e-300, 1e-300, 0]), (15, [0.0, 0, 1]), (0, [0.0, 0, 1])]
    assert found(spark, vectors) == brute(vectors, 0.95)
    assert found(spark, []) == []
    assert found(spark, [(1, None)]) == [(1, 0, 1, True)]


@pytest.mark.parametrize("block_rows", [16, 1000])
def test_against_brute_force(spark, block_rows):
    random = np.random.default_rng(block_rows)
    centres = random.normal(size=(40, 20))
    rows = centres[random.integers(0, 40, 240)] + random.normal(size=(240, 20)) * random.choice([0.0, 0.1, 0.2, 0.25], (240, 1))
    vectors = [(int(i), list(map(float, row))) for i, row in enumerate(rows)]
    assert found(spark, vectors, block_rows=block_rows) == brute(vectors, 0.95)


def test_different_vectors_of_one_id(spark):
    few = [(1, [1.0, 0, 0]), (1, [0.0, 1, 0]), (2, [1.0, 0.01, 0])]
    assert found(spark, few) == brute(few, 0.95) and (1, 0, 1, True) in found(spark, few)
    random = np.random.default_rng(8)
    centres = random.normal(size=(30, 12))
    rows = centres[random.integers(0, 30, 150)] + random.normal(size=(150, 12)) * random.choice([0.0, 0.1, 0.2], (150, 1))
    vectors = [(int(i) // 3, list(map(float, row))) for i, row in enumerate(rows)]
    assert found(spark, vectors, block_rows=40) == brute(vectors, 0.95)


def test_pruned_tiles_lose_nothing():
    random = np.random.default_rng(1)
    rows = random.normal(size=(3000, 64)) * np.linspace(2, 0.1, 64)
    rows[1::3] = rows[::3] + random.normal(size=(1000, 64)) * 0.2
    rows = E._unit(rows)
    axes = E.principal_axes(rows)
    assert np.allclose(axes.T @ axes, np.eye(64))
    pairs = {(int(i), int(j)) for a, b in E.tile_links(rows, None, axes, 0.95) for i, j in zip(a, b)}
    left, right = np.nonzero(np.triu(rows @ rows.T >= 0.95, 1))
    assert pairs == set(zip(left.tolist(), right.tolist())) and len(pairs) > 100


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(50, 51), (51, 50), (60, 60), (70, 90), (80, 90), (70, 100)]
    rows = connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    expected = {i: 0 for i in range(1, 41)} | {51: 50, 80: 70, 90: 70, 100: 70}
    assert dict(map(tuple, rows)) == expected and len(rows) == len(expected)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
