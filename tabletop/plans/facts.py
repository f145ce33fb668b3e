"""Registered queries for table profiles, keys, references and field types."""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletop.functions.text import size_text
from tabletop.operators.composite import check_composite_reference, discover_composite_references, minimal_keys
from tabletop.operators.fields import field_types
from tabletop.operators.keys import candidate_keys, check_reference, discover_keys, discover_references
from tabletop.operators.profile import (
    KEY_SCHEMA,
    database_totals,
    list_tables,
    profile_tables,
    row_bounds,
    row_counts,
    table_columns,
    table_sizes,
    union_all,
)
from tabletop.operators.query import first_rows
from tabletop.plans.register import registered
from tabletop.plans.tables import ALL, CONTENT, SALES, table
from tabletop.plans.transfer import new_database
from tabletop.session import open_tables
from tabletop.sources.documents import document_column

_TYPES = """CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
            WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE 'string' END"""


def _each(names: list[str], text: str) -> str:
    return " UNION ALL ".join(text.replace("$t", name) for name in names)


@registered("p1_list_tables", _each(ALL, f"""SELECT '$t' AS "table", CAST({len(ALL)} AS BIGINT) AS table_count"""))
def tables_of_database(spark: SparkSession, folder: str) -> DataFrame:
    database = new_database(spark)
    for name in ALL:
        spark.sql(f"CREATE TABLE {database}.{name} USING parquet LOCATION '{folder}/{name}.parquet'")
    return list_tables(spark, database)


@registered(
    "p2_table_columns",
    _each(
        ALL,
        f"""SELECT '$t' AS "table", column_name AS "column", {_TYPES} AS type,
                   CAST(ROW_NUMBER() OVER () AS INT) AS position FROM (DESCRIBE $t)""",
    ),
)
def columns_of_tables(spark: SparkSession, folder: str) -> DataFrame:
    return table_columns(open_tables(spark, folder, ALL))


@registered("p3_row_counts", _each(ALL, """SELECT '$t' AS "table", COUNT(*) AS row_count FROM $t"""))
def counts_of_tables(spark: SparkSession, folder: str) -> DataFrame:
    return row_counts(open_tables(spark, folder, ALL))


@registered("p4_table_sizes")
def sizes_of_tables(spark: SparkSession, folder: str) -> DataFrame:
    return table_sizes(spark, {name: f"{folder}/{name}.parquet" for name in ALL})


_SIZES = """SELECT doc_id, factor, n_chars * factor AS size,
                   CASE WHEN n_chars * factor < 1024 THEN (n_chars * factor) || ' B'
                        WHEN n_chars * factor < 1048576 THEN printf('%.1f KB', n_chars * factor / 1024)
                        WHEN n_chars * factor < 1073741824 THEN printf('%.1f MB', n_chars * factor / 1048576)
                        ELSE printf('%.2f GB', n_chars * factor / 1073741824) END AS size_pretty
            FROM documents, (VALUES (CAST(1 AS BIGINT)), (64), (4097), (1000003)) AS f(factor)"""


@registered("n2_size_text", _SIZES)
def texts_of_sizes(spark: SparkSession, folder: str) -> DataFrame:
    factors = F.explode(F.array(*[F.lit(n).cast("bigint") for n in (1, 64, 4097, 1000003)])).alias("factor")
    sized = table(spark, folder, "documents").select("doc_id", "n_chars", factors)
    sized = sized.select("doc_id", "factor", (F.col("n_chars") * F.col("factor")).alias("size"))
    return sized.withColumn("size_pretty", size_text(F.col("size")))


@registered(
    "p5_size_pretty",
    """SELECT source, SUM(n_chars)::BIGINT AS size_bytes,
              CASE WHEN SUM(n_chars) < 1024 THEN SUM(n_chars) || ' B'
                   WHEN SUM(n_chars) < 1048576 THEN printf('%.1f KB', SUM(n_chars)::BIGINT / 1024)
                   WHEN SUM(n_chars) < 1073741824 THEN printf('%.1f MB', SUM(n_chars)::BIGINT / 1048576)
                   ELSE printf('%.2f GB', SUM(n_chars)::BIGINT / 1073741824) END AS size_pretty
       FROM documents GROUP BY source""",
)
def sizes_of_sources(spark: SparkSession, folder: str) -> DataFrame:
    sizes = table(spark, folder, "documents").groupBy("source").agg(F.sum("n_chars").alias("size_bytes"))
    return sizes.withColumn("size_pretty", size_text(F.col("size_bytes")))


def _found_keys(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """Discovered keys in the shape a catalog gives: the first one as primary key, the others as unique."""
    found = discover_keys(open_tables(spark, folder, names), 1)
    rows = [(name, [c for c, in keys[:1]], [c for c, in keys[1:]], []) for name, keys in found.items()]
    return spark.createDataFrame(rows, KEY_SCHEMA)


# Columns of the given tables by kind; "embedding" has no order and is in no key.
_COLUMNS = {
    "region": {"int": "r_regionkey", "text": "r_name"},
    "nation": {"int": "n_nationkey n_regionkey", "text": "n_name"},
    "customer": {"int": "c_custkey c_nationkey", "text": "c_name c_mktsegment", "double": "c_acctbal"},
    "supplier": {"int": "s_suppkey s_nationkey", "text": "s_name", "double": "s_acctbal"},
    "part": {"int": "p_partkey p_size", "text": "p_name p_brand p_type", "double": "p_retailprice"},
    "orders": {
        "int": "o_orderkey o_custkey", "text": "o_orderstatus o_orderpriority", "double": "o_totalprice", "time": "o_orderdate"},
    "lineitem": {
        "int": "l_orderkey l_partkey l_suppkey l_linenumber", "text": "l_returnflag l_linestatus",
        "double": "l_quantity l_extendedprice l_discount l_tax", "time": "l_shipdate"},
    "events": {"int": "event_id user_id", "text": "event_type props", "double": "value", "time": "ts"},
    "documents": {"int": "doc_id n_chars", "text": "text lang source"},
    "embeddings": {"int": "vec_id label"},
    "pages": {"int": "page_id", "text": "url html"},
    "benchmark": {"int": "item_id", "text": "text"},
    "labels": {"int": "doc_id quality toxic"},
    "conversations": {"int": "conv_id turn", "text": "role text"},
}


def _columns(name: str, kinds: str = "int text double time") -> list[str]:
    return [column for kind in kinds.split() for column in _COLUMNS[name].get(kind, "").split()]


# The order of columns in the files, where it is not that of their kinds.
_ORDERS = {
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": (
        "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"),
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
}


def _schema_order(name: str) -> list[str]:
    return _ORDERS[name].split() if name in _ORDERS else _columns(name)


def _profile_check(name: str) -> str:
    """The first column of a table that is a key, if any, and its bounds."""
    columns = _schema_order(name)
    facts = ", ".join(
        f"COUNT(*) = COUNT(DISTINCT {c}) AS u{i}, MIN({c})::VARCHAR AS low{i}, MAX({c})::VARCHAR AS high{i}" for i, c in enumerate(columns))
    first = lambda what: "CASE " + " ".join(f"WHEN u{i} THEN {what(i, c)}" for i, c in enumerate(columns)) + " END"
    return f"""SELECT '{name}' AS "table", n AS row_count, {first(lambda i, c: f"low{i}")} AS first_pk, {first(lambda i, c: f"high{i}")} AS last_pk,
                      COALESCE({first(lambda i, c: f"'{c}'")}, '') AS primary_key,
                      (SELECT COUNT(*) FROM (DESCRIBE {name}))::INT AS column_count, true AS has_size
               FROM (SELECT COUNT(*) AS n, {facts} FROM {name})"""


@registered("p6_table_profile", " UNION ALL ".join(map(_profile_check, ALL)))
def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """The whole profile of lake tables; its nested columns are shown as plain values here."""
    keys = _found_keys(spark, folder, ALL)
    sizes = table_sizes(spark, {name: f"{folder}/{name}.parquet" for name in ALL})
    profile = profile_tables(open_tables(spark, folder, ALL), keys, sizes)
    return profile.select(
        "table",
        "row_count",
        "first_pk",
        "last_pk",
        F.array_join("primary_keys", ",").alias("primary_key"),
        F.size("columns").alias("column_count"),
        (F.col("size_bytes") > 0).alias("has_size"),
    )


def _single_keys() -> str:
    return " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{name}' AS "table", '{column}' AS "column")
            WHERE (SELECT COUNT(*) = COUNT(DISTINCT {column}) FROM {name})"""
        for name in ALL
        for column in _columns(name)
    )


@registered("p7_unique_columns", _single_keys())
def unique_columns(spark: SparkSession, folder: str) -> DataFrame:
    tables = open_tables(spark, folder, ALL)
    rows = [(name, column) for name, keys in discover_keys(tables, 1).items() for column, in keys]
    return spark.createDataFrame(rows, "`table` string, column string")


@registered("p9_candidate_keys", _single_keys())
def keys_of_tables(spark: SparkSession, folder: str) -> DataFrame:
    keys = _found_keys(spark, folder, ALL)
    merged = candidate_keys(F.col("primary_keys"), F.array_union("unique_keys", "primary_keys"))
    return keys.select("table", F.explode(merged).alias("column"))


@registered(
    "p10_row_bounds",
    """SELECT 'orders' AS "table", MIN(o_orderkey)::VARCHAR AS first_pk, MAX(o_orderkey)::VARCHAR AS last_pk FROM orders
       UNION ALL SELECT 'lineitem', MIN(l_orderkey)::VARCHAR, MAX(l_orderkey)::VARCHAR FROM lineitem
       UNION ALL SELECT 'events', MIN(ts)::VARCHAR, MAX(ts)::VARCHAR FROM events
       UNION ALL SELECT 'pages', MIN(url), MAX(url) FROM pages""",
)
def bounds_of_tables(spark: SparkSession, folder: str) -> DataFrame:
    keys = {"orders": "o_orderkey", "lineitem": "l_orderkey", "events": "ts", "pages": "url"}
    return row_bounds(open_tables(spark, folder, list(keys)), keys)


def _key_check(name: str, columns: list[str]) -> str:
    """Single key columns, or pairs where there are none."""
    def unique(keys: tuple[str, ...]) -> str:
        return f"(SELECT COUNT(DISTINCT ({', '.join(keys)})) = COUNT(*) FROM {name})"

    def candidate(keys: tuple[str, ...], condition: str) -> str:
        row = f"""SELECT '{name}' AS "table", '{','.join(keys)}' AS columns, {len(keys)} AS width"""
        return f"SELECT * FROM ({row}) WHERE {unique(keys)} {condition}"

    no_single = " ".join(f"AND NOT {unique((column,))}" for column in columns)
    singles = [candidate((column,), "") for column in columns]
    pairs = [candidate((a, b), no_single) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return " UNION ALL ".join(singles + pairs)


_LINEITEM = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag "
    "l_linestatus l_shipdate"
).split()


@registered(
    "p11_discover_keys",
    _key_check("lineitem", _LINEITEM) + " UNION ALL " + _key_check("conversations", ["conv_id", "turn", "role", "text"]),
)
def found_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Key columns, and pairs of columns that tell all rows apart where no single one does."""
    found = discover_keys(open_tables(spark, folder, ["lineitem", "conversations"]))
    rows = [(name, ",".join(columns), len(columns)) for name, keys in found.items() for columns in keys]
    return spark.createDataFrame(rows, "`table` string, columns string, width int")


def _minimal_keys(width: int) -> str:
    """Unique combinations of columns no part of which is unique, in the order of ``ALL`` and its columns."""
    texts = []
    for name in ALL:
        some = [some for k in range(1, width + 1) for some in combinations(_schema_order(name), k)]
        number = {columns: i for i, columns in enumerate(some)}
        counts = ", ".join(f"COUNT(DISTINCT ({', '.join(columns)})) = COUNT(*) AS u{i}" for columns, i in number.items())
        listed = ", ".join(
            f"CASE WHEN u{i}" + "".join(
                f" AND NOT u{number[part]}" for k in range(1, len(columns)) for part in combinations(columns, k))
            + f" THEN '{','.join(columns)}' END" for columns, i in number.items())
        texts.append(f"""SELECT '{name}' AS "table", unnest(list_filter([{listed}], lambda x: x IS NOT NULL)) AS columns
                         FROM (SELECT {counts} FROM {name})""")
    return f"""SELECT "table", columns, CAST(len(string_split(columns, ',')) AS INTEGER) AS width FROM ({" UNION ALL ".join(texts)})"""


@registered("p11_minimal_keys", _minimal_keys(4))
def all_minimal_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Every combination of up to four columns that tells rows apart while no part of it does, of all tables."""
    found = minimal_keys(open_tables(spark, folder, ALL))
    rows = [(name, ",".join(columns), len(columns)) for name, keys in found.items() for columns in keys]
    return spark.createDataFrame(rows, "`table` string, columns string, width int")


_REFERENCES = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "doc_id", "documents", "doc_id"),
    ("documents", "doc_id", "labels", "doc_id"),
    ("customer", "c_custkey", "orders", "o_custkey"),
]


@registered(
    "p12_check_reference",
    " UNION ALL ".join(
        f"""SELECT '{child}.{column}' AS child, '{parent}.{key}' AS parent, COUNT({column}) AS child_rows,
                   COUNT(*) FILTER (WHERE {column} NOT IN (SELECT {key} FROM {parent})) AS orphan_rows,
                   COUNT(DISTINCT {column}) FILTER (WHERE {column} NOT IN (SELECT {key} FROM {parent})) AS orphan_values
            FROM {child}"""
        for child, column, parent, key in _REFERENCES
    ),
)
def checked_references(spark: SparkSession, folder: str) -> DataFrame:
    tables = open_tables(spark, folder, ALL)
    return union_all(
        check_reference(tables[child], column, tables[parent], key).select(
            F.lit(f"{child}.{column}").alias("child"), F.lit(f"{parent}.{key}").alias("parent"), "*"
        )
        for child, column, parent, key in _REFERENCES
    )


def _reference_check() -> str:
    """Columns of one kind whose values all occur in a column of another table that is a key; long values by digest."""
    values, keys = [], []
    for kind in ("int", "text", "double", "time"):
        for name in ALL:
            for column in _columns(name, kind):
                values.append(f"""SELECT '{kind}' AS kind, '{name}' AS t, '{column}' AS c, md5({column}::VARCHAR) AS v, COUNT(*) AS n
                                  FROM {name} WHERE {column} IS NOT NULL GROUP BY {column}""")
                keys.append(f"SELECT '{name}' AS t, '{column}' AS c, COUNT(*) = COUNT(DISTINCT {column}) AS is_key FROM {name}")
    return f"""
        WITH vals AS MATERIALIZED ({" UNION ALL ".join(values)}),
        keys AS ({" UNION ALL ".join(keys)}),
        parents AS (SELECT kind, t, c, v FROM vals JOIN keys USING (t, c) WHERE is_key),
        sizes AS (SELECT t, c, COUNT(*) AS different, SUM(n)::BIGINT AS child_rows FROM vals GROUP BY t, c),
        common AS (
          SELECT x.t, x.c, p.t AS parent_table, p.c AS parent_column, COUNT(*) AS n
          FROM vals x JOIN parents p ON x.kind = p.kind AND x.v = p.v AND x.t <> p.t GROUP BY ALL)
        SELECT t AS child_table, c AS child_column, parent_table, parent_column, child_rows
        FROM common JOIN sizes USING (t, c) WHERE n = different"""


@registered("p8_discover_references", _reference_check())
def found_references(spark: SparkSession, folder: str) -> DataFrame:
    """What could be a foreign key in tables that declare none: between all columns and the keys that are found."""
    tables = open_tables(spark, folder, ALL)
    keys = {name: [column for column, in some] for name, some in discover_keys(tables, 1).items()}
    return discover_references(tables, keys)


def _composite_check() -> str:
    """Pairs of whole numbers contained in a pair that is a key of another table while no column of it is."""
    values, keys = [], []
    for name in ALL:
        for a, b in permutations(_columns(name, "int"), 2):
            values.append(f"SELECT '{name}' AS t, '{a},{b}' AS c, {a}::BIGINT AS x, {b}::BIGINT AS y, COUNT(*) AS n FROM {name} GROUP BY ALL")
        for a, b in combinations(_columns(name, "int"), 2):
            keys.append(f"""SELECT '{name}' AS t, '{a},{b}' AS c, COUNT(*) = COUNT(DISTINCT ({a}, {b})) AND COUNT(*) > COUNT(DISTINCT {a})
                            AND COUNT(*) > COUNT(DISTINCT {b}) AS is_key FROM {name}""")
    return f"""
        WITH vals AS MATERIALIZED ({" UNION ALL ".join(values)}),
        keys AS ({" UNION ALL ".join(keys)}),
        parents AS (SELECT t, c, x, y FROM vals JOIN keys USING (t, c) WHERE is_key),
        sizes AS (SELECT t, c, COUNT(*) AS different, SUM(n)::BIGINT AS child_rows FROM vals GROUP BY t, c),
        common AS (
          SELECT v.t, v.c, p.t AS parent_table, p.c AS parent_columns, COUNT(*) AS n
          FROM vals v JOIN parents p ON v.x = p.x AND v.y = p.y AND v.t <> p.t GROUP BY ALL)
        SELECT t AS child_table, c AS child_columns, parent_table, parent_columns, child_rows
        FROM common JOIN sizes USING (t, c) WHERE n = different"""


@registered("p8_composite_references", _composite_check())
def found_composite_references(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of whole-number columns of all tables that could refer to a key of two columns."""
    tables = {name: df.select(*_columns(name, "int")) for name, df in open_tables(spark, folder, ALL).items()}
    found = discover_composite_references(tables, minimal_keys(tables, 2))
    return found.select(
        "child_table", F.array_join("child_columns", ",").alias("child_columns"), "parent_table",
        F.array_join("parent_columns", ",").alias("parent_columns"), "child_rows")


_PAIRS = [
    ("lineitem", "l_orderkey l_linenumber", "conversations", "conv_id turn"),
    ("lineitem", "l_partkey l_suppkey", "lineitem", "l_partkey l_suppkey"),
    ("conversations", "conv_id turn", "lineitem", "l_orderkey l_linenumber"),
    ("nation", "n_nationkey n_regionkey", "customer", "c_custkey c_nationkey"),
]


@registered(
    "p12_check_composite_reference",
    " UNION ALL ".join(
        f"""SELECT '{child}({columns})' AS child, '{parent}({keys})' AS parent, COUNT(*) AS child_rows,
                   COUNT(*) FILTER (known IS NULL) AS orphan_rows, COUNT(DISTINCT (x, y)) FILTER (known IS NULL) AS orphan_values
            FROM (SELECT {columns.split()[0]} AS x, {columns.split()[1]} AS y FROM {child}) c
            LEFT JOIN (SELECT DISTINCT {keys.split()[0]} AS a, {keys.split()[1]} AS b, 1 AS known FROM {parent}) p
              ON c.x = p.a AND c.y = p.b"""
        for child, columns, parent, keys in _PAIRS
    ),
)
def checked_composite_references(spark: SparkSession, folder: str) -> DataFrame:
    tables = open_tables(spark, folder, ALL)
    return union_all(
        check_composite_reference(tables[child], columns.split(), tables[parent], keys.split()).select(
            F.lit(f"{child}({columns})").alias("child"), F.lit(f"{parent}({keys})").alias("parent"), "*")
        for child, columns, parent, keys in _PAIRS
    )


@registered(
    "p13_field_types",
    """WITH n AS (SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE role = 'user') AS users FROM conversations)
       SELECT 'conv_id' AS field, 'int' AS type, total AS present FROM n
       UNION ALL SELECT 'role', 'str', total FROM n UNION ALL SELECT 'body', 'dict', total FROM n
       UNION ALL SELECT 'mixed', 'int,str', total FROM n UNION ALL SELECT 'ratio', 'float', total FROM n
       UNION ALL SELECT 'words', 'list', users FROM n UNION ALL SELECT 'first', 'bool', total FROM n
       UNION ALL SELECT 'gap', 'NoneType', total FROM n""",
)
def types_of_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Messages as documents, with a field of two types, one that is not always there, and nested ones."""
    is_user = F.col("role") == "user"
    doc = F.concat(
        F.lit('{"gap": null, "ratio": 1.5, "mixed": '),
        F.when(is_user, F.col("turn").cast("string")).otherwise(F.concat(F.lit('"'), "role", F.lit('"'))),
        F.lit(', "first": '),
        (F.col("turn") == 0).cast("string"),
        F.when(is_user, F.lit(', "words": [1, "a"]')).otherwise(""),
        F.lit(", "),
        F.ltrim(F.to_json(F.struct("conv_id", "role", F.struct("turn", "text").alias("body"))), F.lit("{")),
    )
    docs = table(spark, folder, "conversations").select(document_column(doc).alias("doc"))
    return field_types(docs).select("field", "type", "present")


_EXTENT = "(SELECT COUNT(*) FROM (DESCRIBE $t)) AS c, (SELECT COUNT(*) FROM $t) AS n"


@registered(
    "p14_database_totals",
    f"""WITH t AS (
          {_each(SALES, f"SELECT 'sales' AS d, {_EXTENT}")} UNION ALL {_each(CONTENT, f"SELECT 'content' AS d, {_EXTENT}")})
        SELECT d AS database, COUNT(*) AS table_count, SUM(c)::BIGINT AS total_columns, SUM(n)::BIGINT AS total_rows
        FROM t GROUP BY ROLLUP (d)""",
)
def totals(spark: SparkSession, folder: str) -> DataFrame:
    def part(database: str, names: list[str]) -> DataFrame:
        return profile_tables(open_tables(spark, folder, names)).withColumn("database", F.lit(database))

    profile = part("sales", SALES).unionByName(part("content", CONTENT))
    return database_totals(profile).drop("total_bytes")


@registered(
    "p15_sample_rows",
    """SELECT * FROM (SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 4)""",
)
def sample_rows(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return first_rows(orders.orderBy("o_orderkey"), 4)
