"""Session settings, shared working folders and registration of table views."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that only concern how plans adapt to the data; cluster sizing is left to the submitter.
SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even where that costs one more shuffle after the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def build_session(app_name: str = "tabletop", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the adaptive settings above; ``settings`` use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by the cluster in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tabletop-"))
    return context.getCheckpointDir().rstrip("/")


def working_folder(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark)}/tabletop/{label}-{uuid.uuid4().hex}"


def open_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Parquet tables ``<folder>/<name>.parquet`` as DataFrames."""
    return {name: spark.read.parquet(os.path.join(folder, f"{name}.parquet")) for name in names}


def register_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Same, and also as temporary views so that SQL text can name them."""
    tables = open_tables(spark, folder, names)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return tables
