"""Query results kept under a name as Parquet, next to a working copy the user may change."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletop.functions.text import GIB, size_text

SOURCE = "source.parquet"
WORKING = "working.parquet"
LISTING_SCHEMA = "name string, file string, size_bytes bigint, size_pretty string, memory_safe boolean"


def _folder(root: str, name: str) -> str:
    if not re.fullmatch(r"[^/\\:*?\[\]{}]+", name) or name.strip(".") == "" or name[0] in "._":
        raise ValueError(f"not a usable snapshot name: {name!r}")
    return f"{root.rstrip('/')}/{name}"


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target, jvm


def _replace(df: DataFrame, path: str) -> None:
    """Write beside ``path`` and swap at the end: ``df`` may read ``path``, and a failed job leaves it untouched."""
    spark = df.sparkSession
    folder, _, last = path.rpartition("/")
    mark = uuid.uuid4().hex
    fresh, stale = f"{folder}/_new-{mark}-{last}", f"{folder}/_old-{mark}-{last}"
    files, target, jvm = _file_system(spark, path)
    new, old = jvm.org.apache.hadoop.fs.Path(fresh), jvm.org.apache.hadoop.fs.Path(stale)
    try:
        df.write.option("compression", "snappy").parquet(fresh)
        if files.exists(target) and not files.rename(target, old):
            raise OSError(f"cannot move {path} aside")
        if not files.rename(new, target):
            raise OSError(f"cannot move {fresh} to {path}")
    except Exception:
        # What was there stays there.
        if files.exists(old) and not files.exists(target):
            files.rename(old, target)
        if files.exists(new):
            files.delete(new, True)
        raise
    if files.exists(old):
        files.delete(old, True)
    spark.catalog.refreshByPath(path)


def write_snapshot(df: DataFrame, root: str, name: str) -> str:
    """Keep ``df`` as ``<root>/<name>/source.parquet``, replacing an older one; an empty result keeps its schema."""
    lowered = [column.lower() for column in df.columns]
    twice = sorted({column for column in lowered if lowered.count(column) > 1})
    if twice:
        raise ValueError(f"column names occur more than once: {', '.join(twice)}")
    typed = [
        F.col(f"`{field.name}`").cast("string").alias(field.name)
        if isinstance(field.dataType, T.NullType)
        else F.col(f"`{field.name}`")
        for field in df.schema
    ]
    path = f"{_folder(root, name)}/{SOURCE}"
    _replace(df.select(*typed), path)
    return path


def read_snapshot(spark: SparkSession, root: str, name: str, working: bool = False) -> DataFrame:
    return spark.read.parquet(f"{_folder(root, name)}/{WORKING if working else SOURCE}")


def restore_working(spark: SparkSession, root: str, name: str) -> str:
    """Set the working copy back to the source."""
    path = f"{_folder(root, name)}/{WORKING}"
    _replace(read_snapshot(spark, root, name), path)
    return path


def write_working(df: DataFrame, root: str, name: str) -> str:
    """Replace the working copy; the source stays as it is."""
    path = f"{_folder(root, name)}/{WORKING}"
    _replace(df, path)
    return path


def delete_snapshot(spark: SparkSession, root: str, name: str) -> bool:
    """Remove a snapshot with its working copy; whether there was one."""
    files, target, _ = _file_system(spark, _folder(root, name))
    return files.exists(target) and files.delete(target, True)


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """``name``, ``file``, ``size_bytes``, ``size_pretty``, ``memory_safe`` (below 1 GiB) of every snapshot.

    Folders without a source are left out. Only file lengths are read.
    """
    files, target, _ = _file_system(spark, f"{root.rstrip('/')}/*/{SOURCE}")
    if not files.globStatus(target):
        return spark.createDataFrame([], LISTING_SCHEMA)
    parts = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(f"{root.rstrip('/')}/*/{SOURCE}")
        .select("path", "length")
    )
    name = F.regexp_extract("path", rf"([^/]+)/{re.escape(SOURCE)}(/|$)", 1)
    sizes = parts.groupBy(name.alias("name"), F.lit(SOURCE).alias("file")).agg(
        F.sum("length").alias("size_bytes")
    )
    size = F.col("size_bytes")
    return sizes.select("*", size_text(size).alias("size_pretty"), (size < GIB).alias("memory_safe"))


def total_storage(snapshots: DataFrame) -> DataFrame:
    """One row: bytes of all listed files, and as text."""
    total = snapshots.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("size_bytes"))
    return total.withColumn("size_pretty", size_text(F.col("size_bytes")))
