"""Results as CSV or JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletop.functions.text import plain_text
from tabletop.sources.files import NO_VALUE

_NATIVE_JSON = (T.StringType, T.BooleanType, T.IntegralType, T.FloatType, T.DoubleType)
_NESTED = (T.ArrayType, T.StructType, T.MapType, T.VariantType)


def export_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Header and rows as CSV part files; a null is an empty field, quotes inside values are doubled.

    A null that is a row's only field is written as a mark that ``read_csv`` takes as null: readers skip empty lines.
    """
    texts = [plain_text(field.name, field.dataType).alias(field.name) for field in df.schema]
    (
        df.select(*texts)
        .write.option("header", True)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("nullValue", NO_VALUE if len(texts) == 1 else "")
        .csv(path)
    )


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as a JSON array in column ``value``: numbers and booleans stay such, dates and decimals become text."""
    def cell(field: T.StructField):
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, _NESTED):
            return F.parse_json(F.to_json(value))
        if not isinstance(field.dataType, _NATIVE_JSON):
            value = plain_text(field.name, field.dataType)
        return value.cast("variant")

    return df.select(F.to_json(F.array(*[cell(field) for field in df.schema])).alias("value"))


def export_json(df: DataFrame, path: str) -> None:
    """``<path>/headers``: one JSON array of column names; ``<path>/rows``: one JSON array per row."""
    spark = df.sparkSession
    header = spark.range(1, numPartitions=1).select(F.to_json(F.array(*[F.lit(name) for name in df.columns])))
    json_rows(df).write.text(f"{path}/rows")
    header.write.text(f"{path}/headers")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """An ``export_json`` folder as text columns under its headers."""
    header = spark.read.text(f"{path}/headers").select(F.from_json("value", "array<string>").alias("names"))
    names = header.head()["names"]
    cells = spark.read.text(f"{path}/rows").select(F.from_json("value", "array<string>").alias("cells"))
    return cells.select([F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(names)])
