"""Hard negatives: for pairs of an anchor and a positive, the best scored rows of other labels below the positive.

Rows are put in the order of a Hilbert curve through their leading principal axes (fitted on a bounded sample; any axes give the same
results, good ones prune more) and written as blocks of bounded size, one Parquet row each, with a zone map: the smallest
and largest value of every dimension. Interval arithmetic bounds the scores that an anchor can have with the rows of a block from both
sides. A block is read for an anchor only if these bounds meet one of the anchor's windows of scores and the block has
rows of a fitting label. For positives the window is open above and starts at the score that the anchor's own block offers; for negatives there is
one window for each positive. Anchors are read in chunks of bounded size, so that a task compares one chunk with one block. All
scores are exact whole numbers.

Defined results: the score is the inner product of whole numbers; higher ones come first, ties by smaller id. Rows with a null
id or label, a null or empty vector, a null component or one beyond +-2^24 take no part. Vectors of different
lengths never meet. Repeated rows count each, but none is a positive of an anchor with the same id. Positives with a negative score have
no negatives. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabletop.llm.common import stored
from tabletop.llm.embedding_dedup import principal_axes

BLOCK_ROWS = 512
CHUNK_ROWS = 512
ZONES = 512
SAMPLE_ROWS = 4096
AXES, BITS = 8, 7
LIMIT = 1 << 24
_PARTITION_ROWS = 65_536


def hilbert_keys(places: np.ndarray, bits: int) -> np.ndarray:
    """Positions on a Hilbert curve of points with coordinates below 2^bits; bits times dimensions stay below 63."""
    axes = [column.astype(np.int64) for column in places.T]
    bit = 1 << (bits - 1)
    while bit > 1:
        below = bit - 1
        for i in range(len(axes)):
            upper = (axes[i] & bit) != 0
            swap = np.where(upper, 0, (axes[0] ^ axes[i]) & below)
            axes[0] = np.where(upper, axes[0] ^ below, axes[0]) ^ swap
            axes[i] = axes[i] ^ swap if i else axes[0]
        bit >>= 1
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros(len(places), np.int64)
    bit = 1 << (bits - 1)
    while bit > 1:
        turn = np.where(axes[-1] & bit, turn ^ (bit - 1), turn)
        bit >>= 1
    key = np.zeros(len(places), np.int64)
    for place in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << 1 | ((axis ^ turn) >> place & 1)
    return key


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers."""
    if not a.size or not b.size or float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def score_bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest score that each anchor can have with what lies between ``low`` and ``high``, by interval arithmetic."""
    above, below = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(above, low) + products(below, high), products(above, high) + products(below, low)


def best(scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``keep`` best fitting scores of each row; ties by smaller id."""
    order = np.argsort(ids, kind="stable")
    scores, fits = scores[:, order], fits[:, order]
    n = len(ids)
    if float(np.abs(scores).max(initial=0)) * n < 2**61:
        rank = np.where(fits, scores * n - np.arange(n), -(1 << 62))
        chosen = np.argpartition(-rank, keep - 1, axis=1)[:, :keep] if n > keep else np.tile(np.arange(n), (len(scores), 1))
    else:
        chosen = np.stack([np.lexsort((np.arange(n), -row, ~fit))[:keep] for row, fit in zip(scores, fits)])
    row = np.repeat(np.arange(len(scores)), chosen.shape[1])
    column = chosen.ravel()
    good = fits[row, column]
    return row[good], order[column[good]]


_BLOCK = ("block bigint, ids array<bigint>, labels array<bigint>, anchors array<boolean>, vectors array<int>, "
          "low array<int>, high array<int>, kinds array<bigint>")


def blocks_of(rows: DataFrame, width: int, block_rows: int, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Blocks of ``rows`` (``vec_id``, ``label``, ``vector``, ``anchor``), neighbours on the Hilbert curve, with their zone maps."""
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vector").toArrow()
    sampled = _matrix(sample.column("vector"), width).astype(np.float64)
    axes = principal_axes(sampled - sampled.mean(axis=0))[:, :AXES]
    cuts = np.quantile(sampled @ axes, np.linspace(0, 1, (1 << BITS) + 1)[1:-1], axis=0)
    held = spark.sparkContext.broadcast((axes, cuts))

    def place(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, cuts = held.value
        for frame in frames:
            turned = _matrix(frame.column("vector"), width) @ axes
            places = np.column_stack([np.searchsorted(cut, column) for cut, column in zip(cuts.T, turned.T)])
            yield pa.RecordBatch.from_arrays(
                [*frame.columns, pa.array(hilbert_keys(places, BITS), pa.int64())], [*frame.schema.names, "key"])

    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        open_: list[pa.RecordBatch] = []
        for frame in frames:
            open_.append(frame)
            while sum(part.num_rows for part in open_) >= block_rows:
                table = pa.Table.from_batches(open_).combine_chunks()
                yield _block(number, table.slice(0, block_rows), width)
                number += 1
                open_ = table.slice(block_rows).to_batches()
        if sum(part.num_rows for part in open_):
            yield _block(number, pa.Table.from_batches(open_), width)

    keyed = rows.mapInArrow(place, "vec_id bigint, label bigint, vector array<int>, anchor boolean, key bigint")
    partitions = rows.count() // _PARTITION_ROWS + 1
    dealt = keyed.repartitionByRange(partitions, "key", "vec_id").sortWithinPartitions("key", "vec_id")
    return dealt.mapInArrow(pack, _BLOCK)


def _lists(types: list[tuple[list, pa.DataType]]) -> list[pa.Array]:
    return [pa.array([values], pa.list_(kind)) for values, kind in types]


def _block(number: int, table: pa.Table, width: int) -> pa.RecordBatch:
    vectors, labels = _matrix(table.column("vector"), width), table.column("label").to_numpy()
    columns = _lists([
        (table.column("vec_id").to_numpy(), pa.int64()), (labels, pa.int64()), (table.column("anchor").to_pylist(), pa.bool_()),
        (vectors.ravel(), pa.int32()), (vectors.min(axis=0), pa.int32()), (vectors.max(axis=0), pa.int32()),
        (np.unique(labels), pa.int64())])
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), *columns],
        ["block", "ids", "labels", "anchors", "vectors", "low", "high", "kinds"])


_CHUNK = ("chunk bigint, ids array<bigint>, labels array<bigint>, vectors array<int>, owners array<int>, "
          "lows array<bigint>, highs array<bigint>")
_LEAST, _MOST = -(1 << 62), 1 << 62


def chunks_of(blocks: DataFrame, width: int, chunk_rows: int, keep: int) -> DataFrame:
    """Chunks of anchors of neighbouring blocks, each with one window that starts at the ``keep``-th score in the anchor's block."""
    def seed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, lows = [], [], [], []
        number = TaskContext.get().partitionId() << 32

        def chunk() -> pa.RecordBatch:
            columns = _lists([
                (ids[:chunk_rows], pa.int64()), (labels[:chunk_rows], pa.int64()),
                (np.concatenate(vectors[:chunk_rows]), pa.int32()), (np.arange(len(ids[:chunk_rows])), pa.int32()),
                (lows[:chunk_rows], pa.int64()), ([_MOST] * len(ids[:chunk_rows]), pa.int64())])
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), *columns], ["chunk", "ids", "labels", "vectors", "owners", "lows", "highs"])

        for frame in frames:
            for i in range(frame.num_rows):
                rows, own, kind, mark = (
                    _matrix(frame.column("vectors").slice(i, 1), width), *(
                        frame.column(name)[i].values.to_numpy(zero_copy_only=False) for name in ("ids", "labels", "anchors")))
                mark = np.flatnonzero(mark)
                if not len(mark):
                    continue
                scores = products(rows[mark], rows)
                fits = (kind[mark][:, None] == kind) & (own[mark][:, None] != own)
                row, column = best(scores, fits, own, keep)
                floor = np.full(len(mark), _MOST)
                np.minimum.at(floor, row, scores[row, column])
                lows += np.where(np.bincount(row, minlength=len(mark)) >= keep, floor, _LEAST).tolist()
                ids += own[mark].tolist()
                labels += kind[mark].tolist()
                vectors += list(rows[mark])
                while len(ids) >= chunk_rows:
                    yield chunk()
                    number += 1
                    for some in (ids, labels, vectors, lows):
                        del some[:chunk_rows]
        if ids:
            yield chunk()

    return blocks.select("ids", "labels", "anchors", "vectors").mapInArrow(seed, _CHUNK)


def blocks_to_read(chunks: DataFrame, blocks: DataFrame, width: int, same_label: bool, zones: int = ZONES) -> DataFrame:
    """``chunk``, ``block`` and the ``windows`` of the chunk that the block's zone map does not rule out."""
    groups = blocks.count() // zones + 1
    zone = F.struct("block", "low", "high", "kinds")
    maps = blocks.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups))).groupBy("group").agg(F.collect_list(zone).alias("zones"))
    asked = chunks.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1))).alias("group"))

    def choose(table: pa.Table) -> pa.Table:
        zones = table.column("zones").combine_chunks().flatten()
        number, low, high, kinds = (zones.field(name) for name in ("block", "low", "high", "kinds"))
        anchors, labels = _matrix(table.column("vectors"), width), _flat(table, "labels")
        owners, lows, highs = (_flat(table, name) for name in ("owners", "lows", "highs"))
        least, most = score_bounds(anchors, _matrix(low, width), _matrix(high, width))
        known, place = np.unique(labels, return_inverse=True)
        has = np.zeros((len(known), len(number)), bool)
        other = np.zeros_like(has)
        for j, some in enumerate(kinds.to_pylist()):
            has[:, j] = np.isin(known, some)
            other[:, j] = ~has[:, j] | (len(some) > 1)
        fits = (has if same_label else other)[place]
        wanted = fits[owners] & (most[owners] >= lows[:, None]) & (least[owners] <= highs[:, None])
        read = np.flatnonzero(wanted.any(axis=0))
        return pa.table({
            "chunk": pa.array([table.column("chunk")[0].as_py()] * len(read), pa.int64()), "block": number.take(pa.array(read)),
            "windows": pa.array([np.flatnonzero(wanted[:, j]) for j in read], pa.list_(pa.int32()))})

    return asked.join(maps, "group").groupBy("chunk", "group").applyInArrow(choose, "chunk bigint, block bigint, windows array<int>")


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def search(chunks: DataFrame, blocks: DataFrame, width: int, same_label: bool, keep: int, zones: int = ZONES) -> DataFrame:
    """``chunk``, ``window``, ``rank``, ``vec_id``, ``score``: the ``keep`` best rows in each window, of its anchor's label or of others."""
    pairs = stored(blocks_to_read(chunks, blocks, width, same_label, zones), "pairs")
    mine = chunks.select("chunk", F.col("ids").alias("anchor_ids"), F.col("labels").alias("anchor_labels"),
                         F.col("vectors").alias("anchors"), "owners", "lows", "highs")
    tiles = pairs.join(blocks.select("block", "ids", "labels", "vectors"), "block").join(mine, "chunk")

    def read(table: pa.Table) -> pa.Table:
        rows, anchors = (_matrix(table.column(name), width) for name in ("vectors", "anchors"))
        ids, labels, windows = (_flat(table, name) for name in ("ids", "labels", "windows"))
        owner = _flat(table, "owners")[windows]
        low, high = _flat(table, "lows")[windows], _flat(table, "highs")[windows]
        scores = products(anchors, rows)[owner]
        equal = _flat(table, "anchor_labels")[owner][:, None] == labels
        fits = (scores >= low[:, None]) & (scores <= high[:, None])
        fits &= equal & (_flat(table, "anchor_ids")[owner][:, None] != ids) if same_label else ~equal
        row, column = best(scores, fits, ids, keep)
        return pa.table({
            "chunk": pa.array([table.column("chunk")[0].as_py()] * len(row), pa.int64()), "window": pa.array(windows[row], pa.int32()),
            "vec_id": pa.array(ids[column], pa.int64()), "score": pa.array(scores[row, column], pa.int64())})

    found = tiles.groupBy("chunk", "block").applyInArrow(read, "chunk bigint, window int, vec_id bigint, score bigint")
    order = Window.partitionBy("chunk", "window").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def mine(rows: DataFrame, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95,
         block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS, zones: int = ZONES) -> DataFrame:
    """Of ``rows`` (``vec_id``, ``label``, ``vector`` of whole numbers, ``anchor``): the hard negatives of all anchors and positives.

    Positives are the first ``positives`` other rows of the anchor's label; negatives the first ``negatives`` rows of other
    labels with ``least`` to ``most`` percent of the positive's score. Columns ``anchor_id``, ``positive_id``, ``rank``,
    ``negative_id``, ``positive_score``, ``negative_score``.
    """
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & F.forall(
        "vector", lambda x: x.isNotNull() & (x >= -LIMIT) & (x <= LIMIT))
    usable = rows.where(sound).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
        F.col("vector").cast("array<int>").alias("vector"), F.coalesce("anchor", F.lit(False)).alias("anchor"))
    usable = stored(usable, "vectors")
    found = rows.sparkSession.createDataFrame([], (
        "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"))
    for (width,) in usable.where("anchor").select(F.size("vector")).distinct().sort(F.size("vector")).collect():
        blocks = stored(blocks_of(usable.where(F.size("vector") == width), width, block_rows), "blocks")
        chunks = stored(chunks_of(blocks, width, chunk_rows, positives), "chunks")
        best_ = search(chunks, blocks, width, True, positives, zones).select(
            "chunk", F.col("window").alias("owner"), "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        best_ = stored(best_.where("positive_score >= 0"), "positives")
        # The windows of a chunk: a bounded number of anchors, each with a few positives.
        held = best_.groupBy("chunk").agg(F.array_sort(F.collect_list(
            F.struct("owner", "rank", "positive_id", "positive_score"))).alias("held"))
        windows = stored(chunks.drop("owners", "lows", "highs").join(held, "chunk").select(
            "*", F.transform("held", lambda x: x["owner"]).alias("owners"),
            F.expr(f"transform(held, x -> (cast(x.positive_score as decimal(20)) * {least} + 99) div 100)").alias("lows"),
            F.expr(f"transform(held, x -> (cast(x.positive_score as decimal(20)) * {most}) div 100)").alias("highs")), "windows")
        below = search(windows.drop("held"), blocks, width, False, negatives, zones)
        pairs = windows.select("chunk", "ids", F.posexplode("held").alias("window", "pair")).select(
            "chunk", "window", F.get("ids", F.col("pair.owner")).alias("anchor_id"), "pair.positive_id", "pair.positive_score")
        found = found.unionByName(below.join(pairs, ["chunk", "window"]).select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score")))
    return found
