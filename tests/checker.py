"""Side by side: a registered query on Spark and its SQL text on DuckDB, over the same Parquet files."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def kind(data_type: pa.DataType) -> str:
    checks = [
        (pa.types.is_integer, "int"), (pa.types.is_floating, "float"), (pa.types.is_boolean, "bool"),
        (pa.types.is_date, "date"), (pa.types.is_timestamp, "timestamp"), (pa.types.is_decimal, "decimal"),
        (pa.types.is_list, "list"), (pa.types.is_large_list, "list"), (pa.types.is_struct, "struct"),
    ]
    for check, name in checks:
        if check(data_type):
            return name
    return "string" if pa.types.is_string(data_type) or pa.types.is_large_string(data_type) else str(data_type)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def rows_of(table: pa.Table) -> tuple[dict[str, str], Counter]:
    names = sorted(table.column_names)
    columns = [table.column(name).to_pylist() for name in names]
    rows = Counter(repr(row) for row in zip(*columns))
    return {name: kind(table.schema.field(name).type) for name in names}, rows


def compare(spark_table: pa.Table, duck_table: pa.Table) -> list[str]:
    spark_kinds, spark_rows = rows_of(spark_table)
    duck_kinds, duck_rows = rows_of(duck_table)
    problems = []
    if spark_kinds != duck_kinds:
        odd = sorted(set(spark_kinds.items()) ^ set(duck_kinds.items()))
        problems.append(f"columns differ: {odd}")
    if spark_rows != duck_rows:
        problems.append(f"rows differ: {spark_table.num_rows} on Spark, {duck_table.num_rows} on DuckDB")
        problems += [f"  only Spark:  {row[:400]}" for row in list(spark_rows - duck_rows)[:2]]
        problems += [f"  only DuckDB: {row[:400]}" for row in list(duck_rows - spark_rows)[:2]]
    return problems


def main(folder: str, wanted: list[str]) -> int:
    import __spark_entry__ as entry_module

    from tabletop.session import build_session

    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g"
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    failed = 0
    for name, query in queries.items():
        if wanted and not any(part in name for part in wanted):
            continue
        start = time.time()
        try:
            result = query(spark, folder).toArrow()
            seconds = time.time() - start
            if name not in oracles:
                print(f"rows  {name:32s} {result.num_rows:8d} rows {seconds:6.2f} s", flush=True)
                continue
            problems = compare(result, con.sql(oracles[name]).to_arrow_table())
        except Exception as error:  # noqa: BLE001 - a report, not a handler
            seconds, problems = time.time() - start, [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'same'}  {name:32s} {result.num_rows:8d} rows {seconds:6.2f} s", flush=True)
        for problem in problems:
            print(f"      {problem}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
