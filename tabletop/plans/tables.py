"""The tables that registered queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabletop.session import open_tables

SALES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
CONTENT = ["events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
ALL = SALES + CONTENT


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return open_tables(spark, folder, [name])[name]
