import numpy as np
import pytest
from checker import compare, connect

from tabletop.llm import hard_negatives as H
from tabletop.llm.queries import CHECKS, op13_hard_negatives

SCHEMA = "vec_id bigint, label bigint, vector array<bigint>, anchor boolean, block int, ids string"


def sound(row):
    vec_id, label, vector, _ = row
    return None not in (vec_id, label) and bool(vector) and all(x is not None and abs(x) <= H.LIMIT for x in vector)


def brute(rows, positives=5, negatives=3, least=50, most=95):
    found, rows = [], [row for row in rows if sound(row)]
    for a in rows:
        if a[3]:
            scored = [(-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in rows if len(b[2]) == len(a[2])]
            same = sorted((s, i) for s, i, label in scored if label == a[1] and i != a[0])
            other = sorted((s, i) for s, i, label in scored if label != a[1])
            for score, positive in same[:positives]:
                fit = [(s, i) for s, i in other if least * -score <= 100 * -s <= most * -score]
                found += [(a[0], positive, k + 1, i, -score, -s) for k, (s, i) in enumerate(fit[:negatives])]
    return sorted(found)


def found(spark, rows, **options):
    df = spark.createDataFrame([(*row, 1, "x") for row in rows], SCHEMA)
    return sorted(map(tuple, H.mine(df, **options).collect()))


def clustered(seed, number, width, spread=20):
    random = np.random.default_rng(seed)
    centres = random.normal(0, 60, (8, width))
    near = random.integers(0, 8, number)
    vectors = np.floor(centres[near] + random.normal(0, spread, (number, width))).astype(int)
    labels = np.where(random.random(number) < 0.7, near % 4, random.integers(0, 4, number))
    return [(int(i), int(label), list(map(int, vector)), i % 9 == 0) for i, (label, vector) in enumerate(zip(labels, vectors))]


@pytest.mark.parametrize("options", [{}, {"block_rows": 16, "chunk_rows": 8, "zones": 4}, {"positives": 2, "negatives": 9, "least": 10, "most": 100, "block_rows": 50}])
def test_against_brute_force(spark, options):
    rows = clustered(len(options), 400, 12)
    # Ties, repeated rows and an id on two vectors.
    rows += rows[:30] + [(i, *rows[j][1:]) for i, j in ((7, 3), (401, 9), (402, 18), (403, 18))]
    expected = brute(rows, *(options.get(k, d) for k, d in (("positives", 5), ("negatives", 3), ("least", 50), ("most", 95))))
    assert len(expected) > 200 and found(spark, rows, **options) == expected


def test_odd_rows(spark):
    rows = clustered(1, 60, 3) + [
        (None, 1, [1, 2, 3], True), (500, None, [1, 2, 3], True), (501, 1, None, True), (502, 1, [], True), (503, 1, [1, None, 3], True),
        (504, 1, [1, 2, H.LIMIT + 1], True), (505, 1, [9, 9], True), (506, 1, [9, 8], False), (507, 2, [7, 7], False),
        (508, 1, [H.LIMIT, H.LIMIT, 0], True), (509, 1, [H.LIMIT - 1, H.LIMIT, 1], False), (510, 2, [H.LIMIT // 2 + 9, H.LIMIT, 1], None),
        (-50, 3, [0, 0, 0], True), (-7, 3, [-5, -5, -5], True)]
    assert found(spark, rows, block_rows=8) == brute(rows)
    assert found(spark, []) == found(spark, rows[:5][1:]) == []


def test_hilbert_curve_takes_single_steps():
    for width, bits in ((2, 4), (3, 3), (4, 2)):
        every = np.stack(np.meshgrid(*[np.arange(1 << bits)] * width, indexing="ij"), -1).reshape(-1, width)
        keys = H.hilbert_keys(every, bits)
        assert sorted(keys) == list(range(len(every)))
        assert (np.abs(np.diff(every[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_zone_maps_rule_out_blocks_and_bounds_hold(spark):
    rows = clustered(5, 2000, 8, 4)
    usable = spark.createDataFrame(rows, "vec_id bigint, label bigint, vector array<int>, anchor boolean")
    blocks = H.stored(H.blocks_of(usable, 8, 32), "blocks")
    chunks = H.stored(H.chunks_of(blocks, 8, 16, 5), "chunks")
    pairs = H.blocks_to_read(chunks, blocks, 8, True).collect()
    asked = sum(row[3] for row in rows) * blocks.count()
    assert sum(len(row.windows) for row in pairs) < 0.5 * asked
    assert sum(len(row.ids) for row in chunks.collect()) == sum(row[3] for row in rows)
    random = np.random.default_rng(2)
    some, anchors = random.integers(-99, 99, (50, 6)), random.integers(-99, 99, (9, 6))
    low, high = H.score_bounds(anchors, some.min(axis=0)[None], some.max(axis=0)[None])
    scores = anchors @ some.T
    assert (low <= scores.min(axis=1)[:, None]).all() and (high >= scores.max(axis=1)[:, None]).all()


def test_query(spark, small):
    assert compare(op13_hard_negatives(spark, small).toArrow(), connect(small).sql(CHECKS["op13_hard_negatives"]).to_arrow_table()) == []
