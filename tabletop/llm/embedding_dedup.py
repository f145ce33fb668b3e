"""Near duplicates among vectors by PCA-ordered tiles.

Equal vectors are one. The others are turned to their principal axes (fitted on a bounded sample; any turn gives the same
results, a good one is faster) and cut into blocks by their first coordinate. Two blocks form a tile if their ranges come
closer than two linked vectors can be apart; a tile is one group of Spark's, at most two blocks of bounded size. In a
tile, the products of the leading coordinates are summed first. What the rest can add is bounded by the product of the
norms of the rest, and a pair is given up as soon as its cosine cannot reach the threshold; the few that remain are
computed in full, in double precision. A tile returns no pairs, only the number of links of each vector and a
spanning set of edges, and components are found from these by Spark.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do rows
with a null id; they are components of their own. Vectors of different lengths do not link. Repeated rows count as
separate vectors, and so do different vectors of one id: each has its own links and component. The cosine at the threshold counts as a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletop.llm.common import connected_components, stored

BLOCK_ROWS = 8192
SAMPLE_ROWS = 4096
_STEP_DIMENSIONS = (16, 32)
_MARGIN = 1e-9


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def principal_axes(rows: np.ndarray) -> np.ndarray:
    """Orthonormal axes as columns, the one with the largest spread first."""
    width = rows.shape[1]
    _, axes = np.linalg.eigh(rows.T @ rows + 1e-12 * np.eye(width))
    return axes[:, ::-1]


def _join_labels(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Give both ends of every pair, and all that share their labels, the smallest label."""
    while True:
        a, b = labels[left], labels[right]
        if (a == b).all():
            return
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(labels, high, low)
        while (labels != labels[labels]).any():
            labels[:] = labels[labels]


def tile_links(first: np.ndarray, second: np.ndarray | None, axes: np.ndarray, threshold: float) -> Iterator[tuple]:
    """Index pairs with a cosine of at least ``threshold``: rows of ``first`` with rows of ``second`` or, if that is None,
    with later rows of ``first``. Yields arrays of bounded size."""
    same = second is None
    second = first if same else second
    turned, other = first @ axes, second @ axes
    width = axes.shape[0]
    lead = min(_STEP_DIMENSIONS[0], width)
    rest = lambda rows, start: np.sqrt(np.maximum((rows[:, start:]**2).sum(axis=1), 0))
    # The norms of the rest stand as one more coordinate: one product gives the bound.
    bounded = np.column_stack([turned[:, :lead], rest(turned, lead)])
    bounded_other = np.column_stack([other[:, :lead], rest(other, lead)])
    steps = [step for step in _STEP_DIMENSIONS[1:] if step < width]
    rests = {step: (rest(turned, step), rest(other, step)) for step in steps}
    height, breadth = 1024, 4096
    for top in range(0, len(first), height):
        for edge in range(top if same else 0, len(second), breadth):
            bound = bounded[top:top + height] @ bounded_other[edge:edge + breadth].T
            near = bound >= threshold - _MARGIN
            count = int(near.sum())
            if not count:
                continue
            if count > 0.05 * near.size:
                full = first[top:top + height] @ second[edge:edge + breadth].T
                left, right = np.nonzero(full >= threshold)
                left, right = left + top, right + edge
                found = [(left, right)]
            else:
                left, right = np.nonzero(near)
                left, right = left + top, right + edge
                found = []
                for cut in range(0, len(left), 65_536):
                    a, b = left[cut:cut + 65_536], right[cut:cut + 65_536]
                    for step in steps:
                        partial = np.einsum("ij,ij->i", turned[a, :step], other[b, :step])
                        open_ = partial + rests[step][0][a] * rests[step][1][b] >= threshold - _MARGIN
                        a, b = a[open_], b[open_]
                    open_ = np.einsum("ij,ij->i", first[a], second[b]) >= threshold
                    found.append((a[open_], b[open_]))
            for a, b in found:
                if same:
                    later = a < b
                    a, b = a[later], b[later]
                if len(a):
                    yield a, b


def links(vectors: DataFrame, width: int, threshold: float, block_rows: int, sample_rows: int) -> DataFrame:
    """Of unique vectors (``rep``, ``n``, ``embedding``) of one length: ``rep``, ``root``, ``links``, a row for each tile."""
    spark = vectors.sparkSession
    sample = vectors.orderBy(F.xxhash64("rep"), "rep").limit(sample_rows).select("embedding").toArrow()
    sampled = _unit(_matrix(sample.column("embedding"), width))
    axes = principal_axes(sampled)
    blocks = -(-vectors.count() // block_rows)
    cuts = np.quantile(sampled @ axes[:, 0], np.linspace(0, 1, blocks + 1)[1:-1])
    # Unit vectors with this cosine are so far apart, in every coordinate at most.
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    low, high = np.concatenate([[-np.inf], cuts]), np.concatenate([cuts, [np.inf]])
    held = spark.sparkContext.broadcast((axes, cuts, np.searchsorted(high, low - reach), np.searchsorted(low, high + reach) - 1))

    def place(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, cuts, first, last = held.value
        for frame in frames:
            if not frame.num_rows:
                continue
            block = np.searchsorted(cuts, _unit(_matrix(frame.column("embedding"), width)) @ axes[:, 0], side="right")
            more = [pa.array(values, pa.int64()) for values in (block, first[block], last[block])]
            yield pa.RecordBatch.from_arrays([*frame.columns, *more], [*frame.schema.names, "block", "first", "last"])

    def compare(tile: pa.Table) -> pa.Table:
        block = tile.column("block").to_numpy()
        rows = _unit(_matrix(tile.column("embedding"), width))
        reps, n = tile.column("rep").to_numpy(), tile.column("n").to_numpy()
        order = np.lexsort((reps, block))
        block, rows, reps, n = block[order], rows[order], reps[order], n[order]
        split = int((block == block[0]).sum())
        both = tile.column("x")[0].as_py() != tile.column("y")[0].as_py()
        found, labels = np.zeros(len(rows), np.int64), np.arange(len(rows))
        pairs = ()
        if not both:
            pairs = tile_links(rows, None, held.value[0], threshold)
        elif split < len(rows):
            pairs = ((a, b + split) for a, b in tile_links(rows[:split], rows[split:], held.value[0], threshold))
        for a, b in pairs:
            found += np.bincount(a, n[b], len(rows)).astype(np.int64) + np.bincount(b, n[a], len(rows)).astype(np.int64)
            _join_labels(labels, a, b)
        linked = np.flatnonzero(found)
        return pa.table({"rep": reps[linked], "root": reps[labels[linked]], "links": found[linked]})

    schema = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in vectors.schema)
    placed = vectors.mapInArrow(place, f"{schema}, block bigint, first bigint, last bigint")
    tiles = placed.select("rep", "n", "embedding", "block", F.explode(F.sequence("first", "last")).alias("other"))
    tiles = tiles.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).drop("other")
    return tiles.groupBy("x", "y").applyInArrow(compare, "rep bigint, root bigint, links bigint")


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding",
    block_rows: int = BLOCK_ROWS, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row a vector: ``vec_id``, ``n_links``, ``component_id`` and ``kept``."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("embedding"))
    sound = F.col("vec_id").isNotNull() & F.coalesce(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0), F.lit(False))
    usable = rows.where(sound)
    # A number of its own for every different vector: ids may repeat on different ones.
    unique = usable.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    unique = stored(unique.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    found = None
    for (width,) in unique.select(F.size("embedding")).distinct().sort(F.size("embedding")).collect():
        some = links(unique.where(F.size("embedding") == width).drop("least"), width, threshold, block_rows, sample_rows)
        found = some if found is None else found.union(some)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.lit(True).alias("kept"))
    found = stored(found, "links")
    groups = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    facts = unique.join(counted, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    facts = stored(facts.select(
        F.col("embedding").alias("same"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("root"), "least"), "vectors")
    facts = facts.drop("least").join(facts.groupBy("root").agg(F.min("least").alias("component_id")), "root").drop("root")
    joined = rows.join(facts, sound & (rows.embedding == facts.same), "left")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"))
