"""What can be reached over links, cycles included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletop.session import working_folder


def reachable(links: DataFrame, source: str, target: str, starts: DataFrame) -> DataFrame:
    """``start``, ``node`` and ``steps``: every node that can be reached from each of ``starts`` (its first column) over ``links``, with
    the fewest steps; a start reaches itself in 0.

    Rounds join only the pairs that were new in the round before. Each round is written to the shared folder, so that a lost
    executor costs no more than its part of one round, and plans do not grow; the search ends with the first round that
    finds nothing new. Rounds are as many as the longest of all shortest ways. Pairs are starts times nodes at most: a closure of all nodes
    has that size too. Links from or to null lead nowhere, repeated ones and repeated or null starts count once or not at all.
    """
    spark = links.sparkSession
    folder = working_folder(spark, "reach")
    ways = f"{folder}/links"
    kept = links.select(F.col(source).alias("_from"), F.col(target).alias("node"))
    kept.where("_from IS NOT NULL AND node IS NOT NULL AND _from <> node").distinct().write.parquet(ways)
    # Schemas are given, so that no round looks for them in files; rounds are partitions of one folder.
    kinds = T.StructType([T.StructField(name, kept.schema[name].dataType) for name in ("_from", "node")])
    ways = spark.read.schema(kinds).parquet(ways)
    kind = ways.schema["node"].dataType
    first = starts.select(F.col(starts.columns[0]).alias("start")).dropna().distinct()
    first = first.select("start", F.col("start").cast(kind).alias("node"))
    rounds = f"{folder}/rounds"

    def put(pairs: DataFrame, steps: int) -> DataFrame:
        path = f"{rounds}/round={steps}"
        pairs.write.parquet(path)
        return spark.read.schema(first.schema).parquet(path)

    def known() -> DataFrame:
        return spark.read.schema(T.StructType([*first.schema, T.StructField("round", T.IntegerType())])).parquet(rounds)

    fresh, steps = put(first, 0), 0
    while not fresh.isEmpty():
        steps += 1
        further = fresh.select("start", F.col("node").alias("_from")).join(ways, "_from").select("start", "node").distinct()
        fresh = put(further.join(known(), ["start", "node"], "left_anti"), steps)
    return known().select("start", "node", F.col("round").alias("steps"))
