"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletop.session import working_folder

#: White space in the sense of the word counts: blank and the control characters 9 to 13.
SPACE = " \t\n\x0b\x0c\r"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read back.

    This cuts the lineage: what follows reads files that outlive any executor, and adaptive execution sees plain
    shuffles on both sides of a later join, which it can split when a key is hot.
    """
    spark = df.sparkSession
    path = working_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def portions(texts: list[str | int | None], chars: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of ``texts``, or of texts of these lengths, of about ``chars`` characters each; a longer text stands alone."""
    start = held = 0
    for end, text in enumerate(texts):
        length = text if isinstance(text, int) else len(text or "")
        if end > start and held + length > chars:
            yield start, end
            start, held = end, 0
        held += length
    if start < len(texts):
        yield start, len(texts)


def batches(frames: Iterator[pa.RecordBatch], text: str, chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The arriving batches cut so that none holds more than about ``chars`` characters of column ``text``."""
    for frame in frames:
        texts = frame.column(text).to_pylist()
        for start, end in portions(texts, chars):
            yield frame.slice(start, end - start)


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Components of an undirected graph: ``node`` and the smallest ``component`` it reaches, roots left out.

    ``edges`` has the columns ``a`` and ``b`` of one orderable type. Alternating star contractions: every node hands
    its larger neighbours to its smallest one, then its smaller neighbours, until each node has one edge, to a root. All steps are
    groupings with a map-side minimum and joins whose inputs are files, so a hub is split by adaptive execution;
    only the answer whether that is so reaches the driver. Loops and repeated edges do no harm; no edges give no rows.
    """
    def oriented(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def done(df: DataFrame) -> bool:
        """Whether every edge leads from a node of its own to a root."""
        ends = df.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.union(df.select("b", F.lit(0), F.lit(1)))
        met = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return met.where("up > 1 or (up = 1 and down = 1)").isEmpty()

    current = stored(oriented(edges.select("a", "b")), label)
    while not done(current):
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), label)
        large = oriented(both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = stored(large, label)
        lowest = stored(large.groupBy("a").agg(F.min("b").alias("m")), label)
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = stored(oriented(small.union(lowest.select("a", F.col("m").alias("b")))), label)
    return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
