"""SQL over every source at hand: run it, preview it, turn its rows into JSON."""

from __future__ import annotations

import re
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows a preview shows, and what a statement without rows answers.
PREVIEW_ROWS = 100
DONE = "Query executed successfully"


def sql(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """The result of SQL ``text``; ``{name}`` in it stands for the DataFrame ``frames[name]``.

    Other braces, those of a JSON literal for instance, are text like any other.
    """
    if not frames:
        return spark.sql(text)
    named = "|".join(re.escape(f"{{{name}}}") for name in frames)
    parts = re.split(f"({named})", text)
    # Every second part is one of the names; doubled braces stand for themselves.
    plain = [part if i % 2 else part.replace("{", "{{").replace("}", "}}") for i, part in enumerate(parts)]
    return spark.sql("".join(plain), **frames)


def execute(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """Any statement: its rows, or one row ``Message`` where it has no result."""
    result = sql(spark, text, **frames)
    if result.columns:
        return result
    return spark.range(1).select(F.lit(DONE).alias("Message"))


@dataclass(frozen=True)
class Preview:
    """Header, total, number of rows shown and those rows, of one query."""

    columns: list[str]
    total_rows: int | None
    preview_count: int
    rows: DataFrame


def first_rows(df: DataFrame, limit: int = PREVIEW_ROWS) -> DataFrame:
    """The first ``limit`` rows; in a fixed order only if the query has one."""
    return df.limit(limit)


def preview(df: DataFrame, limit: int = PREVIEW_ROWS) -> Preview:
    """What a user sees of a query. The total is None where counting fails although the first rows can be had."""
    shown = first_rows(df, limit)
    try:
        total = df.count()
    except (PySparkException, Py4JJavaError):
        total = None
    count = shown.count() if total is None else min(total, limit)
    return Preview(df.columns, total, count, shown)


def preview_frame(df: DataFrame, limit: int = PREVIEW_ROWS) -> DataFrame:
    """The same facts as one DataFrame: every shown row carries ``total_rows`` and ``preview_count``."""
    total = df.agg(F.count("*")).scalar()
    shown = first_rows(df, limit).withColumn("total_rows", total)
    return shown.withColumn("preview_count", F.least("total_rows", F.lit(limit).cast("bigint")))


def _json_ready(name: str, data_type: T.DataType):
    value = F.col(f"`{name}`")
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType, T.TimeType)):
        return value.cast("string").alias(name)
    if isinstance(data_type, T.BinaryType):
        return F.base64(value).alias(name)
    if isinstance(data_type, T.NullType):
        return value.cast("string").alias(name)
    return value.alias(name)


def rows_as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON object in column ``json``; what JSON has no type for becomes text, nulls stay visible."""
    ready = [_json_ready(field.name, field.dataType) for field in df.schema]
    return df.select(F.to_json(F.struct(*ready), {"ignoreNullFields": "false"}).alias("json"))
