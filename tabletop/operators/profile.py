"""Facts about tables: columns, types, rows, sizes, bounds, keys; one row per table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletop.functions.text import size_text
from tabletop.operators.keys import candidate_keys
from tabletop.sources.jdbc import bounds_query, count_of, quoted, read_query, read_table, vendor

REFERENCE_TYPE = "array<struct<column:string,references_table:string,references_column:string>>"

KEY_SCHEMA = (
    "`table` string, primary_keys array<string>, unique_keys array<string>, "
    f"foreign_keys {REFERENCE_TYPE}"
)


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def list_tables(spark: SparkSession, namespace: str | None = None) -> DataFrame:
    """Base tables of a namespace, views left out, with the number of them on every row."""
    scope = f" IN {namespace}" if namespace else ""
    found = spark.sql(f"SHOW TABLES{scope}")
    temporary = "isTemporary" in found.columns
    names = (found.where(~F.col("isTemporary")) if temporary else found).select(F.col("tableName").alias("table"))
    if temporary:
        views = spark.sql(f"SHOW VIEWS{scope}").select(F.col("viewName").alias("table"))
        names = names.join(views, "table", "left_anti")
    return names.withColumn("table_count", names.agg(F.count("*")).scalar())


def table_columns(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column: ``table``, ``position`` from 1, ``column``, ``type``. Reads no data."""
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (name, i, field.name, field.dataType.simpleString())
        for name, df in tables.items()
        for i, field in enumerate(df.schema, start=1)
    ]
    return spark.createDataFrame(rows, "`table` string, position int, column string, type string")


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table``, ``row_count``; plain Parquet tables are counted from file footers."""
    return union_all(
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table"), "row_count")
        for name, df in tables.items()
    )


def table_sizes(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """``table``, ``size_bytes``, ``size_pretty``: lengths of the files, contents are not read."""
    def size(name: str, path: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length")
        total = files.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("size_bytes"))
        return total.select(F.lit(name).alias("table"), "size_bytes")

    sizes = union_all(size(name, path) for name, path in paths.items())
    return sizes.withColumn("size_pretty", size_text(F.col("size_bytes")))


def row_bounds(tables: Mapping[str, DataFrame], keys: Mapping[str, str]) -> DataFrame:
    """``table``, ``first_pk``, ``last_pk``: smallest and largest value of the key column as text, in one pass."""
    return union_all(
        tables[name].agg(
            F.min(column).cast("string").alias("first_pk"), F.max(column).cast("string").alias("last_pk")
        ).select(F.lit(name).alias("table"), "first_pk", "last_pk")
        for name, column in keys.items()
    )


def _counts_and_bounds(name: str, df: DataFrame, first_key: str | None) -> DataFrame:
    if first_key:
        low, high = F.min(first_key).cast("string"), F.max(first_key).cast("string")
    else:
        low = high = F.lit(None).cast("string")
    facts = df.agg(F.count("*").alias("row_count"), low.alias("first_pk"), high.alias("last_pk"))
    return facts.select(F.lit(name).alias("table"), "*")


def profile_tables(
    tables: Mapping[str, DataFrame],
    keys: DataFrame | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """One row of facts per table.

    ``keys`` (see ``KEY_SCHEMA``) come from a catalog or from ``discover_keys``; ``sizes`` from ``table_sizes`` or a
    catalog. The data is passed over once per table, for its count and the bounds of its first key column.
    """
    spark = next(iter(tables.values())).sparkSession
    if keys is None:
        keys = spark.createDataFrame([], KEY_SCHEMA)
    if sizes is None:
        sizes = spark.createDataFrame([], "`table` string, size_bytes bigint, size_pretty string")
    first_keys = {
        row["table"]: row["first_key"]
        for row in keys.select("table", F.get("primary_keys", F.lit(0)).alias("first_key")).collect()
    }
    facts = union_all(_counts_and_bounds(name, df, first_keys.get(name)) for name, df in tables.items())
    headers = _headers(tables)
    return _assemble(headers, facts, sizes, keys)


def _headers(tables: Mapping[str, DataFrame]) -> DataFrame:
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(
        [
            (name, df.columns, {field.name: field.dataType.simpleString() for field in df.schema})
            for name, df in tables.items()
        ],
        "`table` string, columns array<string>, column_types map<string,string>",
    )


def _assemble(headers: DataFrame, facts: DataFrame, sizes: DataFrame, keys: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    joined = headers.join(facts, "table").join(sizes, "table", "left").join(keys, "table", "left")
    return joined.select(
        "table",
        "columns",
        "column_types",
        "row_count",
        "size_bytes",
        "size_pretty",
        F.coalesce("primary_keys", none).alias("primary_keys"),
        "first_pk",
        "last_pk",
        F.coalesce("unique_keys", none).alias("unique_keys"),
        candidate_keys(F.coalesce("primary_keys", none), F.coalesce("unique_keys", none)).alias("candidate_keys"),
        F.coalesce("foreign_keys", F.array().cast(REFERENCE_TYPE)).alias("foreign_keys"),
    )


def database_totals(profile: DataFrame) -> DataFrame:
    """Tables, columns, rows and bytes per ``database``, and one overall row whose ``database`` is null."""
    return profile.rollup("database").agg(
        F.count("*").alias("table_count"),
        F.sum(F.size("columns")).cast("bigint").alias("total_columns"),
        F.sum("row_count").cast("bigint").alias("total_rows"),
        F.sum("size_bytes").cast("bigint").alias("total_bytes"),
    )


# What each vendor's catalog says about keys, one row per key column:
# table_name, constraint_name, kind (P, U, F), position, column_name, ref_table, ref_column.
_KEY_COLUMNS = {
    "postgresql": """
        SELECT t.relname AS table_name, c.conname AS constraint_name, upper(c.contype::text) AS kind,
               k.position AS position, a.attname AS column_name, rt.relname AS ref_table, ra.attname AS ref_column
        FROM pg_constraint c
        JOIN pg_class t ON t.oid = c.conrelid
        JOIN pg_namespace n ON n.oid = t.relnamespace
        CROSS JOIN LATERAL unnest(c.conkey, c.confkey) WITH ORDINALITY AS k(col, ref_col, position)
        JOIN pg_attribute a ON a.attrelid = c.conrelid AND a.attnum = k.col
        LEFT JOIN pg_class rt ON rt.oid = c.confrelid
        LEFT JOIN pg_attribute ra ON ra.attrelid = c.confrelid AND ra.attnum = k.ref_col
        WHERE c.contype IN ('p', 'u', 'f') AND n.nspname = '{schema}'""",
    "mysql": """
        SELECT s.TABLE_NAME AS table_name, s.INDEX_NAME AS constraint_name,
               CASE WHEN s.INDEX_NAME = 'PRIMARY' THEN 'P' ELSE 'U' END AS kind, s.SEQ_IN_INDEX AS position,
               s.COLUMN_NAME AS column_name, NULL AS ref_table, NULL AS ref_column
        FROM information_schema.STATISTICS s WHERE s.NON_UNIQUE = 0 AND s.TABLE_SCHEMA = '{schema}'
        UNION ALL
        SELECT k.TABLE_NAME, k.CONSTRAINT_NAME, 'F', k.ORDINAL_POSITION, k.COLUMN_NAME,
               k.REFERENCED_TABLE_NAME, k.REFERENCED_COLUMN_NAME
        FROM information_schema.KEY_COLUMN_USAGE k
        WHERE k.REFERENCED_TABLE_NAME IS NOT NULL AND k.TABLE_SCHEMA = '{schema}'""",
    "sqlserver": """
        SELECT t.name AS table_name, i.name AS constraint_name,
               CASE WHEN i.is_primary_key = 1 THEN 'P' ELSE 'U' END AS kind, ic.key_ordinal AS position,
               c.name AS column_name, NULL AS ref_table, NULL AS ref_column
        FROM sys.indexes i
        JOIN sys.tables t ON t.object_id = i.object_id
        JOIN sys.index_columns ic ON ic.object_id = i.object_id AND ic.index_id = i.index_id AND ic.key_ordinal > 0
        JOIN sys.columns c ON c.object_id = ic.object_id AND c.column_id = ic.column_id
        WHERE (i.is_primary_key = 1 OR i.is_unique_constraint = 1) AND schema_name(t.schema_id) = '{schema}'
        UNION ALL
        SELECT t.name, f.name, 'F', fc.constraint_column_id, c.name, rt.name, rc.name
        FROM sys.foreign_keys f
        JOIN sys.foreign_key_columns fc ON fc.constraint_object_id = f.object_id
        JOIN sys.tables t ON t.object_id = fc.parent_object_id
        JOIN sys.columns c ON c.object_id = fc.parent_object_id AND c.column_id = fc.parent_column_id
        JOIN sys.tables rt ON rt.object_id = fc.referenced_object_id
        JOIN sys.columns rc ON rc.object_id = fc.referenced_object_id AND rc.column_id = fc.referenced_column_id
        WHERE schema_name(t.schema_id) = '{schema}'""",
}

# Base tables and their bytes, data and indexes.
_TABLE_SIZES = {
    "postgresql": """
        SELECT c.relname AS table_name, pg_total_relation_size(c.oid) AS size_bytes
        FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace
        WHERE c.relkind IN ('r', 'p') AND n.nspname = '{schema}'""",
    "mysql": """
        SELECT TABLE_NAME AS table_name, COALESCE(DATA_LENGTH + INDEX_LENGTH, 0) AS size_bytes
        FROM information_schema.TABLES WHERE TABLE_SCHEMA = '{schema}'""",
    "sqlserver": """
        SELECT t.name AS table_name, COALESCE(SUM(p.reserved_page_count), 0) * 8192 AS size_bytes
        FROM sys.tables t LEFT JOIN sys.dm_db_partition_stats p ON p.object_id = t.object_id
        WHERE schema_name(t.schema_id) = '{schema}' GROUP BY t.name""",
}

KEY_COLUMN_SCHEMA = (
    "table_name string, constraint_name string, kind string, position int, column_name string, "
    "ref_table string, ref_column string"
)


def _for_vendor(queries: Mapping[str, str], options: dict[str, str], schema: str) -> str:
    name = vendor(options)
    if name not in queries:
        raise ValueError(f"no catalog query for {name}")
    return queries[name].format(schema=schema.replace("'", "''"))


def keys_from_catalog(key_columns: DataFrame) -> DataFrame:
    """Catalog rows, one per key column, → one row per table in ``KEY_SCHEMA``.

    Columns of a composite foreign key are paired by their position, not with each other.
    """
    def columns_of(kind: str):
        picked = F.collect_list(
            F.when(F.col("kind") == kind, F.struct("constraint_name", "position", "column_name"))
        )
        return F.transform(F.array_sort(picked), lambda key: key["column_name"])

    references = F.collect_list(
        F.when(
            F.col("kind") == "F",
            F.struct("constraint_name", "position", "column_name", "ref_table", "ref_column"),
        )
    )
    return key_columns.groupBy(F.col("table_name").alias("table")).agg(
        columns_of("P").alias("primary_keys"),
        F.array_distinct(columns_of("U")).alias("unique_keys"),
        F.transform(
            F.array_sort(references),
            lambda key: F.struct(
                key["column_name"].alias("column"),
                key["ref_table"].alias("references_table"),
                key["ref_column"].alias("references_column"),
            ),
        ).alias("foreign_keys"),
    )


def declared_keys(spark: SparkSession, options: dict[str, str], schema: str) -> DataFrame:
    """Primary, unique and foreign keys that a remote database declares, all tables in one query."""
    rows = read_query(spark, options, _for_vendor(_KEY_COLUMNS, options, schema))
    return keys_from_catalog(rows.withColumn("position", F.col("position").cast("int")))


def declared_sizes(spark: SparkSession, options: dict[str, str], schema: str) -> DataFrame:
    """Base tables of a remote database and their sizes, in one query."""
    rows = read_query(spark, options, _for_vendor(_TABLE_SIZES, options, schema))
    sizes = rows.select(F.col("table_name").alias("table"), F.col("size_bytes").cast("bigint"))
    return sizes.withColumn("size_pretty", size_text(F.col("size_bytes")))


def profile_remote(spark: SparkSession, options: dict[str, str], schema: str) -> DataFrame:
    """``profile_tables`` for a remote database: counts and bounds are computed there, only facts travel."""
    sizes = declared_sizes(spark, options, schema)
    keys = declared_keys(spark, options, schema)
    names = [row["table"] for row in sizes.select("table").collect()]
    if not names:
        raise ValueError(f"schema {schema} has no tables")
    first_keys = {row["table"]: row["primary_keys"][0] for row in keys.collect() if row["primary_keys"]}
    facts, tables = [], {}
    for name in names:
        source = quoted(options, schema, name)
        # Only the schema of this one is used; nothing is fetched through it.
        tables[name] = read_table(spark, options, name, schema=schema)
        key = first_keys.get(name)
        if key:
            row = read_query(spark, options, bounds_query(options, name, key, schema))
            low, high = F.col("low").cast("string"), F.col("high").cast("string")
        else:
            row = read_query(spark, options, f"SELECT {count_of(options)} AS total FROM {source}")
            low = high = F.lit(None).cast("string")
        facts.append(
            row.select(
                F.lit(name).alias("table"),
                F.col("total").cast("bigint").alias("row_count"),
                low.alias("first_pk"),
                high.alias("last_pk"),
            )
        )
    return _assemble(_headers(tables), union_all(facts), sizes, keys)
