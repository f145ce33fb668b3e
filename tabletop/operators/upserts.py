"""Changing rows of a partitioned Parquet table: only the partitions that a change concerns are rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletop.operators.snapshots import _file_system
from tabletop.session import working_folder


def upsert(changes: DataFrame, path: str, keys: list[str], partitions: list[str]) -> int:
    """Put the rows of ``changes`` in the place of those with equal ``keys``, and add those without one; returns how many partitions
    were rewritten.

    ``changes`` has the table's columns in any order; a row may move to another partition. Two changes of one key are an error; null
    keys equal each other. Where nothing is there yet, the table is made.
    """
    spark = changes.sparkSession
    changes = _stored(changes, "changes")
    if not changes.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"several changes of one key {keys}")
    files, target, _ = _file_system(spark, path)
    if not files.exists(target):
        changes.write.partitionBy(*partitions).parquet(path)
        return changes.select(*partitions).distinct().count()
    table = spark.read.schema(_schema(changes, partitions)).parquet(path)
    return _rewrite(table, path, changes.select(*keys), keys, partitions, changes)


def delete_keys(spark: SparkSession, gone: DataFrame, path: str, keys: list[str], partitions: list[str]) -> int:
    """Delete the rows whose ``keys`` are among those of ``gone``; returns how many partitions were rewritten or dropped."""
    gone = _stored(gone.select(*keys).distinct(), "gone")
    return _rewrite(spark.read.parquet(path), path, gone, keys, partitions, None)


def _schema(df: DataFrame, partitions: list[str]):
    return df.select([name for name in df.columns if name not in partitions] + partitions).schema


def _same(left: DataFrame, right: DataFrame, names: list[str]):
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[f"_{name}"])
    return condition


def _marked(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select([F.col(name).alias(f"_{name}") for name in names])


def _rewrite(table: DataFrame, path: str, concerned: DataFrame, keys: list[str], partitions: list[str], added: DataFrame | None) -> int:
    """The new partitions are written beside the table first; it is touched only when they are whole."""
    spark = table.sparkSession
    marks = _marked(concerned, keys)
    # Keys and partition columns only are read to find the places.
    keyed = table.withColumn("_file", F.col("_metadata.file_path")).select(*dict.fromkeys([*keys, *partitions]), "_file")
    places = keyed.join(marks, _same(keyed, marks, keys), "left_semi")
    places = places.select(*partitions, F.regexp_replace("_file", "/[^/]*$", "").alias("_folder")).distinct()
    places = _stored(places, "places")
    touched = places.select(*partitions)
    if added is not None:
        touched = touched.unionByName(added.select(*partitions))
    touched = _stored(touched.distinct(), "touched")
    wanted = _marked(touched, partitions)
    kept = table.join(wanted, _same(table, wanted, partitions), "left_semi")
    kept = kept.join(marks, _same(kept, marks, keys), "left_anti")
    rows = kept if added is None else kept.unionByName(added)
    fresh = _stored(rows.select(table.columns), "fresh")
    mode = fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    mode.partitionBy(*partitions).parquet(path)
    files, _, _ = _file_system(spark, path)
    # Partitions left without rows are not overwritten by anything.
    filled = _marked(fresh.select(*partitions).distinct(), partitions)
    for row in places.join(filled, _same(places, filled, partitions), "left_anti").select("_folder").distinct().toLocalIterator():
        # Spark gives the file's path as a URI, with escapes.
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(row["_folder"]))
        files.delete(folder, True)
    spark.catalog.refreshByPath(path)
    return touched.count()


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = working_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
