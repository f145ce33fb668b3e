"""Facts about document collections, in the shape of table profiles."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletop.operators.fields import field_types

# Fixed value: the field that every document is known by.
ID_FIELD = "_id"


def profile_collections(collections: Mapping[str, DataFrame], sizes: DataFrame | None = None) -> DataFrame:
    """One row per collection: ``table``, ``row_count``, ``columns`` and ``column_types`` of its top-level fields (sorted),
    ``first_pk`` and ``last_pk`` (bounds of ``_id``), ``primary_keys``, ``unique_keys``, ``candidate_keys`` and sizes.

    ``collections`` holds VARIANT documents in column ``doc``. A collection whose documents have no ``_id`` has no keys and
    no bounds. Ids that are numbers are compared as numbers, others as text. All documents are looked at; each collection
    is read twice, with map-side sums.
    """
    def facts(name: str, docs: DataFrame) -> DataFrame:
        fields = field_types(docs).agg(F.array_sort(F.collect_list(F.struct("field", "type"))).alias("fields"))
        given = F.try_variant_get("doc", f"$.{ID_FIELD}", "variant")
        text = F.try_variant_get("doc", f"$.{ID_FIELD}", "string")
        number = F.when(F.schema_of_variant(given) == "BIGINT", F.try_variant_get("doc", f"$.{ID_FIELD}", "bigint"))
        all_numbers = F.count(number) == F.count(text)
        counted = docs.agg(
            F.count("*").alias("row_count"),
            F.when(all_numbers, F.min(number).cast("string")).otherwise(F.min(text)).alias("first_pk"),
            F.when(all_numbers, F.max(number).cast("string")).otherwise(F.max(text)).alias("last_pk"))
        keys = F.when(F.array_contains("columns", ID_FIELD), F.array(F.lit(ID_FIELD))).otherwise(F.array().cast("array<string>"))
        return counted.join(fields).select(
            F.lit(name).alias("table"), "row_count", "first_pk", "last_pk",
            F.transform("fields", lambda f: f["field"]).alias("columns"),
            F.map_from_entries("fields").alias("column_types"),
        ).select("*", *[keys.alias(kind) for kind in ("primary_keys", "unique_keys", "candidate_keys")])

    found = reduce(DataFrame.unionByName, [facts(name, docs) for name, docs in collections.items()])
    if sizes is None:
        return found.select("*", F.lit(None).cast("bigint").alias("size_bytes"), F.lit(None).cast("string").alias("size_pretty"))
    return found.join(sizes, "table", "left")
