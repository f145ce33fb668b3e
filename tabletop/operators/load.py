"""Append rows to existing tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletop.sources.files import read_csv, read_json
from tabletop.sources.schema import create_table, infer_schema

_NESTED = (T.ArrayType, T.StructType, T.MapType, T.VariantType)


def _lossless(value: Column, source: T.DataType, target: T.DataType, name: str) -> Column:
    """``value`` in the type ``target``; a value that this would change is an error, whatever the session says."""
    if source == target or isinstance(target, (*_NESTED, T.StringType)) or isinstance(source, (*_NESTED, T.NullType)):
        return value.cast(target)
    if isinstance(source, T.StringType):
        made = value.try_cast(target)
        same = F.lit(True)
        if isinstance(target, T.DecimalType):
            wide = value.try_cast(T.DecimalType(38, min(38, target.scale + 12)))
            same = wide.isNull() | (wide == made)
        elif isinstance(target, T.DateType):
            same = value.try_cast("timestamp_ntz").isNull() | (value.try_cast("timestamp_ntz") == made.cast("timestamp_ntz"))
    else:
        made = value.try_cast(target)
        same = made.try_cast(source).eqNullSafe(value)
    lost = value.isNotNull() & (made.isNull() | ~same)
    message = F.concat(F.lit(f"column {name} of type {target.simpleString()} cannot hold the value "), value.cast("string"))
    return F.when(lost, F.raise_error(message).cast(target)).otherwise(made)


def fitted(df: DataFrame, target: T.StructType) -> DataFrame:
    """Columns of ``df`` under the names and types of ``target``, by position; values are kept or refused, never changed."""
    if len(target) != len(df.columns):
        raise ValueError(f"the table has {len(target)} columns, the input has {len(df.columns)}")
    return df.select([
        _lossless(F.col(f"`{given.name}`"), given.dataType, field.dataType, field.name).alias(field.name)
        for given, field in zip(df.schema, target)
    ])


def load_into(table: str, df: DataFrame) -> None:
    """Append ``df`` to ``table``, columns matched by position; all rows or, on any bad value, none.

    Text is converted to the column's type; a value of any type that does not fit, or that the column's type would round
    or cut, is an error. Tasks write aside and the job commits at its end, so a failed load leaves the table as it was.
    That holds for tables of files; an attached database commits task by task, so load a table there that is swapped in
    later.
    """
    fitted(df, df.sparkSession.table(table).schema).write.insertInto(table)


def load_file(spark: SparkSession, path: str, table: str, sep: str | None = None) -> DataFrame:
    """Load a file or folder into ``table`` in one step and return the table.

    The ending of ``path`` picks the reader: ``.json`` and ``.jsonl`` JSON, ``.tsv`` and ``.txt`` tab-separated, ``.csv``
    comma-separated, unless ``sep`` says otherwise. A table that does not exist yet is made with the names and types found
    in the data. Either all rows are loaded or none.
    """
    ending = path.rstrip("/").rpartition(".")[2].lower()
    if ending in ("json", "jsonl"):
        rows = read_json(spark, path)
    elif sep or ending in ("csv", "tsv", "txt"):
        rows = read_csv(spark, path, sep=sep or ("," if ending == "csv" else "\t"))
    else:
        raise ValueError(f"no reader for files that end in .{ending}")
    if not spark.catalog.tableExists(table):
        create_table(spark, table, infer_schema(rows))
    load_into(table, rows)
    return spark.table(table)
