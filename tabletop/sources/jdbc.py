"""Tables and queries of remote databases through Spark's JDBC source.

``options`` is the plain JDBC option map: ``url``, ``user``, ``password``, ``driver``, ``fetchsize`` and so on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEFAULT_SCHEMA = {"postgresql": "public", "sqlserver": "dbo"}


def vendor(options: dict[str, str]) -> str:
    """``postgresql``, ``mysql``, ``sqlserver`` ... as named in the JDBC URL."""
    url = options["url"]
    parts = url.split(":")
    if len(parts) < 3 or parts[0] != "jdbc":
        raise ValueError(f"not a JDBC url: {url}")
    return "mysql" if parts[1] == "mariadb" else parts[1]


def quoted(options: dict[str, str], *names: str | None) -> str:
    """Dotted identifier in the quoting of the vendor."""
    left, right = {"mysql": "``", "sqlserver": "[]"}.get(vendor(options), '""')
    return ".".join(left + name.replace(right, right * 2) + right for name in names if name)


def read_query(spark: SparkSession, options: dict[str, str], sql: str) -> DataFrame:
    """The result of one SELECT that the remote database runs."""
    return spark.read.format("jdbc").options(**options).option("query", sql.strip().rstrip(";")).load()


def count_of(options: dict[str, str]) -> str:
    """Row count that does not overflow: ``COUNT`` of SQL Server ends at 2^31."""
    return "COUNT_BIG(*)" if vendor(options) == "sqlserver" else "COUNT(*)"


def bounds_query(options: dict[str, str], table: str, column: str, schema: str | None = None) -> str:
    name = quoted(options, column)
    return (
        f"SELECT MIN({name}) AS low, MAX({name}) AS high, {count_of(options)} AS total "
        f"FROM {quoted(options, schema, table)}"
    )


def boundary_query(options: dict[str, str], table: str, column: str, parts: int, schema: str | None = None) -> str:
    """First key of each of ``parts`` equally filled ranges: one ordered pass in the database."""
    name = quoted(options, column)
    return (
        f"SELECT part, MIN(k) AS first_key FROM (SELECT {name} AS k, NTILE({parts}) OVER (ORDER BY {name}) AS part "
        f"FROM {quoted(options, schema, table)} WHERE {name} IS NOT NULL) ranges GROUP BY part"
    )


def range_predicates(options: dict[str, str], column: str, first_keys: list) -> list[str]:
    """Disjoint WHERE clauses that cover every row, also rows below the first key and null keys."""
    name = quoted(options, column)
    keys = sorted(set(first_keys))
    inner = [_literal(key) for key in keys[1:]]
    if not inner:
        return ["1 = 1"]
    clauses = [f"{name} < {inner[0]} OR {name} IS NULL"]
    clauses += [f"{name} >= {low} AND {name} < {high}" for low, high in zip(inner, inner[1:])]
    return clauses + [f"{name} >= {inner[-1]}"]


def _literal(value) -> str:
    if isinstance(value, bool) or value is None:
        raise TypeError(f"cannot split a table on {value!r}")
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def read_table(
    spark: SparkSession,
    options: dict[str, str],
    table: str,
    partition_by: str | None = None,
    num_partitions: int | None = None,
    schema: str | None = None,
    balanced: bool = False,
) -> DataFrame:
    """A remote table, read by many tasks when ``partition_by`` names a column.

    A numeric column is cut into equal strides between its smallest and largest value. Any other column, and a numeric
    one with ``balanced=True`` (ids with large gaps), is cut where the row count is even, so that no task gets much more
    than its share; use a unique column for that. Only the bounds or the range starts reach the driver, one per task.
    """
    schema = schema or DEFAULT_SCHEMA.get(vendor(options))
    reader = spark.read.format("jdbc").options(**options).option("dbtable", quoted(options, schema, table))
    if partition_by is None:
        return reader.load()
    parts = num_partitions or spark.sparkContext.defaultParallelism
    probe = read_query(spark, options, bounds_query(options, table, partition_by, schema))
    numeric = probe.schema["low"].dataType.simpleString().split("(")[0] in {
        "tinyint", "smallint", "int", "bigint", "decimal",
    }
    if numeric and not balanced:
        bounds = probe.head()
        if bounds["low"] is None or bounds["low"] == bounds["high"]:
            return reader.load()
        return (
            reader.option("partitionColumn", partition_by)
            .option("lowerBound", int(bounds["low"]))
            .option("upperBound", int(bounds["high"]) + 1)
            .option("numPartitions", parts)
            .load()
        )
    starts = read_query(spark, options, boundary_query(options, table, partition_by, parts, schema)).collect()
    predicates = range_predicates(options, partition_by, [row["first_key"] for row in starts])
    properties = {key: value for key, value in options.items() if key != "url"}
    return spark.read.jdbc(
        options["url"], quoted(options, schema, table), predicates=predicates, properties=properties
    )


def attach(spark: SparkSession, name: str, options: dict[str, str], default_schema: str | None = None) -> None:
    """Make a remote database a catalog, so that SQL can say ``<name>.<schema>.<table>``.

    With ``default_schema`` unqualified names resolve there too.
    """
    prefix = f"spark.sql.catalog.{name}"
    spark.conf.set(prefix, "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
    for key, value in options.items():
        spark.conf.set(f"{prefix}.{key}", value)
    for key in ("pushDownAggregate", "pushDownLimit", "pushDownOffset", "pushDownTableSample"):
        spark.conf.set(f"{prefix}.{key}", options.get(key, "true"))
    if default_schema:
        spark.sql(f"USE `{name}`.`{default_schema}`")
