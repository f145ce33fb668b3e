"""Collections of schemaless documents, kept as VARIANT so that mixed types survive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """A collection as one VARIANT column ``doc``.

    ``path`` names exports with one JSON document per line (splittable at any size). ``options`` instead reads a live
    collection through the MongoDB connector, where that jar is on the classpath.
    """
    if path is not None:
        return spark.read.option("singleVariantColumn", "doc").option("mode", "FAILFAST").json(path)
    rows = spark.read.format("mongodb").options(**(options or {})).load()
    return rows.select(F.to_variant_object(F.struct("*")).alias("doc"))


def document_column(column: str | Column) -> Column:
    """JSON text as a VARIANT document."""
    return F.parse_json(F.col(column) if isinstance(column, str) else column)
