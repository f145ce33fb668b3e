"""Delimited and JSON files as DataFrames."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletop.functions.text import clean_names

# No text is this one, so an unquoted empty field becomes null while a quoted one stays "".
NO_VALUE = "\ue000null\ue000"


def _plain(path: str) -> str:
    """A file's address as a path that a reader takes, the same for every way it was told."""
    return re.sub(r"^file:/+", "file:///", unquote(path))


def _files(df: DataFrame) -> list[str]:
    return [_plain(path) for path in df.inputFiles()]


def _files_with_open_quotes(spark: SparkSession, path: str | list[str], sep: str, quote: str, encoding: str) -> list[str]:
    """Files in which a quoted value goes on in the next line; of the others, a reader may cut every file at any line.

    Only a quote at the start of a field opens a value; one in the middle of a field is a character like any other.
    """
    lines = spark.read.text(path)
    if re.fullmatch(r"(?i)utf-?(16|32).*", encoding):
        return _files(lines)  # line ends cannot be told by single bytes
    q, start = re.escape(quote), f"(^|{re.escape(sep)})"
    whole = rf"{start}{q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q}(?={re.escape(sep)}|$)"
    left = F.regexp_replace("value", F.lit(whole), F.lit("$1"))
    found = lines.where(F.contains("value", F.lit(quote)) & left.rlike(start + q))
    return [_plain(row[0]) for row in found.select("_metadata.file_path").distinct().collect()]


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    sep: str = ",",
    header: bool = True,
    schema: T.StructType | None = None,
    encoding: str = "utf-8",
    multi_line: bool | None = None,
    quote: str = '"',
) -> DataFrame:
    """Comma, tab or otherwise delimited files (``.csv``, ``.txt``, ``.tsv``); without ``schema`` all text.

    Quotes are doubled inside quoted values. An unquoted empty field is null, a quoted empty one is the empty string.
    A file whose quoted values hold line breaks cannot be split among tasks; ``multi_line=None`` looks for such files in
    one scan of lines and keeps every other file splittable. With ``schema`` a bad value or a wrong number of fields is
    an error. Headers of all files must name the same columns in the same order.
    """
    def reader(whole: bool):
        found = (
            spark.read.option("sep", sep)
            .option("header", header)
            .option("enforceSchema", False)
            .option("encoding", encoding)
            .option("quote", quote)
            .option("escape", quote)
            .option("multiLine", whole)
            .option("nullValue", NO_VALUE)
            .option("emptyValue", "")
            .option("mode", "FAILFAST")
        )
        return found if schema is None else found.schema(schema)

    if multi_line is not None:
        return reader(multi_line).csv(path)
    unsplit = _files_with_open_quotes(spark, path, sep, quote, encoding)
    if not unsplit:
        return reader(False).csv(path)
    rest = sorted(set(_files(spark.read.text(path))) - set(unsplit))
    whole = reader(True).csv(sorted(unsplit))
    if not rest:
        return whole
    lines = reader(False).csv(rest)
    if [name.lower() for name in whole.columns] != [name.lower() for name in lines.columns]:
        raise ValueError(f"files have different columns: {whole.columns} and {lines.columns}")
    return lines.union(whole)


def _first_seen_order(lines: DataFrame) -> list[str]:
    """Top-level keys of JSON objects in the order in which the files name them first.

    ``lines`` has the JSON text in ``value``; only the keys, as many as there are columns, reach the driver.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    placed = lines.select("value", *place, F.monotonically_increasing_id().alias("line"))
    objects = placed.select("file", "block", "line", F.explode(_json_objects("value")).alias("value"))
    keys = objects.select("file", "block", "line", F.posexplode(F.json_object_keys("value")).alias("pos", "key"))
    # The least of a number is found without sorting; the rows that are left are few.
    least = keys.groupBy("key", "file", "block", "pos").agg(F.min("line").alias("line"))
    first = least.groupBy("key").agg(F.min(F.struct("file", "block", "line", "pos")).alias("first"))
    return [row["key"] for row in first.orderBy("first").select("key").collect()]


def _json_objects(column: str):
    """The elements of a JSON array, or the single object itself, as JSON texts."""
    is_array = F.ltrim(F.col(column)).startswith("[")
    return F.when(is_array, F.from_json(column, "array<string>")).otherwise(F.array(column))


def _merged(types: list[T.DataType]) -> T.DataType:
    """One type for a column that several groups of files have."""
    kinds = [typ for typ in types if not isinstance(typ, T.NullType)]
    if not kinds:
        return T.StringType()
    if all(typ == kinds[0] for typ in kinds):
        return kinds[0]
    if all(isinstance(typ, (T.LongType, T.DoubleType)) for typ in kinds):
        return T.DoubleType()
    if all(isinstance(typ, T.StructType) for typ in kinds):
        names = dict.fromkeys(name for typ in kinds for name in typ.names)
        return T.StructType([
            T.StructField(name, _merged([typ[name].dataType for typ in kinds if name in typ.names])) for name in names])
    if all(isinstance(typ, T.ArrayType) for typ in kinds):
        return T.ArrayType(_merged([typ.elementType for typ in kinds]))
    return T.StringType()


def _layouts(spark: SparkSession, path: str | list[str], encoding: str) -> tuple[list[str], list[str], list[str]]:
    """Files that hold one object a line, one value as a whole, and one object of equally long arrays.

    The first line with content tells: a complete object means lines, anything else a value over the whole file.
    """
    def one_value(text):
        """The value of a JSON text, null if it is none or more than one."""
        alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
        return F.when(F.try_variant_get(alone, "$[1]", "variant").isNull(), F.try_variant_get(alone, "$[0]", "variant"))

    lines = spark.read.text(path).where(F.trim("value") != "")
    is_object = F.ltrim("value").startswith("{") & one_value(F.col("value")).isNotNull()
    # Place and answer in one number, the least of which is found without sorting; lines of a block are in one task.
    told = F.monotonically_increasing_id() * 2 + F.when(is_object, 1).otherwise(0)
    lines = lines.select("_metadata.file_path", "_metadata.file_block_start", told.alias("told"))
    blocks = lines.groupBy("file_path", "file_block_start").agg(F.min("told").alias("told"))
    first = blocks.groupBy("file_path").agg((F.min_by("told", "file_block_start") % 2 == 1).alias("by_line"))
    shapes = {_plain(row[0]): row[1] for row in first.collect()}
    wholes = [name for name, by_line in shapes.items() if not by_line]
    columns: list[str] = []
    if wholes:
        texts = spark.read.text(wholes, wholetext=True)
        entries = F.try_variant_get(one_value(F.col("value")), "$", "map<string, variant>")
        arrays = F.forall(F.map_values(entries), lambda value: F.schema_of_variant(value).startswith("ARRAY"))
        looked = texts.select(
            "_metadata.file_path", one_value(F.col("value")).isNull().alias("broken"),
            (F.ltrim("value").startswith("{") & (F.size(entries) > 0) & arrays).alias("columns")).collect()
        broken = sorted(row.file_path for row in looked if row.broken)
        if broken:
            raise ValueError(f"not one JSON value and not one object a line: {', '.join(broken[:5])}")
        columns = [_plain(row.file_path) for row in looked if row["columns"]]
    return sorted(set(shapes) - set(wholes)), sorted(set(wholes) - set(columns)), sorted(columns)


def read_json(
    spark: SparkSession, path: str | list[str], schema: T.StructType | None = None, encoding: str = "utf-8"
) -> DataFrame:
    """JSON lines and, in files that are not that, one JSON array of objects, one object or one object of arrays per file.

    The layout is told file by file from the content, so a path may mix them. A line or a file that is not JSON is an
    error. Columns keep the order in which the files name them, their names trimmed and with ``_`` for blanks. ``schema``
    (original names, JSON lines) saves the passes that look for layout, types and order.
    """
    reader = spark.read.option("mode", "FAILFAST").option("encoding", encoding)
    if schema is not None:
        df = reader.schema(schema).json(path)
        return df.toDF(*clean_names(df.columns))
    lines, wholes, by_column = _layouts(spark, path, encoding)
    found, order = [], []
    if lines:
        found.append((reader, lines, reader.json(lines).schema))
        order += _first_seen_order(spark.read.text(lines))
    whole = spark.read.option("mode", "FAILFAST").option("encoding", encoding).option("multiLine", True)
    for files in (wholes, by_column):
        if files:
            found.append((whole, files, whole.json(files).schema))
            order += _first_seen_order(spark.read.text(files, wholetext=True))
    order = list(dict.fromkeys(order))
    if not found:
        return reader.json(path)

    def columns_of(files: list[str], kinds: T.StructType) -> T.StructType:
        if files is not by_column:
            return kinds
        return T.StructType([T.StructField(f.name, f.dataType.elementType) for f in kinds])

    plain = [columns_of(files, kinds) for _, files, kinds in found]
    named = [name for name in order if any(name in kinds.names for kinds in plain)]
    merged = {name: _merged([kinds[name].dataType for kinds in plain if name in kinds.names]) for name in named}
    parts = []
    for source, files, kinds in found:
        own = [name for name in kinds.names if name in merged]
        if files is by_column:
            df = source.schema(T.StructType([T.StructField(n, T.ArrayType(merged[n])) for n in own])).json(files)
            df = df.select(F.inline(F.arrays_zip(*[F.col(f"`{name}`") for name in own])))
        else:
            df = source.schema(T.StructType([T.StructField(n, merged[n]) for n in own])).json(files)
        parts.append(df)
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    df = df.select([F.col(f"`{name}`") for name in named])
    return df.toDF(*clean_names(df.columns))
