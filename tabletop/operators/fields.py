"""Which fields documents have and which types their values take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletop.functions.text import value_kind


def field_types(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Per top-level field: ``field``, ``types`` (sorted, each once), ``type`` (their text), ``present`` (documents).

    ``docs`` holds VARIANT objects; all of them are looked at. Fields and kinds are folded on the map side, so the
    shuffle carries one row per task, field and kind.
    """
    pairs = docs.sparkSession.sql(
        "SELECT entry.key AS field, schema_of_variant(entry.value) AS shape "
        "FROM {seen}, LATERAL variant_explode(doc) AS entry",
        seen=docs.select(F.col(column).alias("doc")),
    )
    kinds = pairs.groupBy("field", value_kind(F.col("shape")).alias("kind")).agg(F.count("*").alias("present"))
    return kinds.groupBy("field").agg(
        F.array_sort(F.collect_set("kind")).alias("types"),
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("type"),
        F.sum("present").alias("present"),
    )
