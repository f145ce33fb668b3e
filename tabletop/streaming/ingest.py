"""Files that arrive one after another in a folder, each loaded once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletop.operators.load import fitted, load_into
from tabletop.operators.state import add_state, has_state
from tabletop.sources.files import _json_objects, _layouts, read_csv

# The number under which the state of what a table held before its first batch is kept.
_BEFORE = -1


def ingest_incremental(
    spark: SparkSession,
    folder: str,
    table: str,
    checkpoint: str,
    file_format: str = "csv",
    sep: str = ",",
    multi_line: bool | None = None,
    max_files: int | None = None,
    batch_column: str | None = None,
    profile: str | None = None,
) -> DataFrame:
    """Append to ``table`` the rows of files in ``folder`` that earlier calls have not seen; returns the table.

    CSV columns are matched by position; JSON files hold one object per line, an array of objects, one object or one object of
    arrays, told file by file as ``read_json`` does it; their fields are matched by name whatever the case. A value
    that does not fit its column, or a field that the table lacks, fails the run, and the next run takes up the same files.
    ``checkpoint`` is the folder that remembers what was loaded: the same one for every call, and reachable by all
    executors. ``max_files`` bounds the files per micro-batch after a long pause. ``multi_line`` is that of ``read_csv``:
    by default each CSV file that can be split is.

    Lost tasks and executors are repeated without doubling rows. A driver that dies in the short time between the
    append and the note in the checkpoint writes that batch again at the next call: name the table's partition column
    in ``batch_column`` to have every batch replace its own partition, so that a repeated batch changes nothing.

    ``profile`` is a folder for the facts of the table's columns (see ``operators.state``): the first call reads what the table
    holds, after that each batch adds the state of its own rows, and only new files are read. ``read_state`` merges them.
    """
    schema = T.StructType([field for field in spark.table(table).schema if field.name != batch_column])
    if file_format not in ("csv", "json"):
        raise ValueError(f"unknown file format: {file_format}")
    if profile and not has_state(spark, profile):
        add_state(spark.table(table).drop(*([batch_column] if batch_column else [])), profile, _BEFORE)
    # The stream carries the names of new files only; their content is read in the batch, as a whole folder would be.
    reader = spark.readStream.format("binaryFile").schema(
        "path string, modificationTime timestamp, length bigint, content binary")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def append(batch: DataFrame, number: int) -> None:
        files = [row.path for row in batch.select("path").collect()]
        if not files:
            return
        if file_format == "csv":
            rows = read_csv(spark, files, sep=sep, multi_line=multi_line)
        else:
            rows = _json_columns(_json_lines(spark, files), schema)
        append_batch(table, rows, number, batch_column)
        if profile:
            add_state(fitted(rows, schema), profile, number)

    query = (
        reader.load(folder)
        .writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(append)
        .start()
    )
    query.awaitTermination()
    spark.catalog.refreshTable(table)
    return spark.table(table)


def _json_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """One JSON object a row in ``value``, whatever the layout of each file is."""
    lines, wholes, by_column = _layouts(spark, files, "utf-8")
    found = spark.createDataFrame([], "value string")
    if lines:
        found = found.union(spark.read.text(lines))
    if wholes:
        found = found.union(spark.read.text(wholes, wholetext=True).select(F.explode(_json_objects("value")).alias("value")))
    if by_column:
        entries = F.from_json("value", "map<string,array<string>>", {"mode": "FAILFAST"})
        rows = spark.read.text(by_column, wholetext=True).select(entries.alias("entries"))
        rows = rows.select("entries", F.explode(F.sequence(
            F.lit(1), F.array_max(F.transform(F.map_values("entries"), F.size)))).alias("row"))
        found = found.union(rows.select(
            F.to_json(F.transform_values("entries", lambda _, values: F.try_element_at(values, F.col("row")))).alias("value")))
    return found


def _json_columns(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Fields of JSON lines as columns of the table; their names are cleaned as ``read_json`` does it, in any case.

    A field that the table lacks is an error, and so are two that differ by case or blanks only.
    """
    entries = F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})
    cleaned = F.transform_keys(entries, lambda key, _: F.lower(F.replace(F.trim(key), F.lit(" "), F.lit("_"))))
    parsed = lines.where(F.trim("value") != "").select(cleaned.alias("entry"))
    known = F.array(*[F.lit(field.name.lower()) for field in schema])
    odd = F.array_except(F.map_keys("entry"), known)
    message = F.concat(F.lit("the table lacks these fields: "), F.array_join(odd, ", "))
    parsed = parsed.select(F.when(F.size(odd) > 0, F.raise_error(message).cast(parsed.schema[0].dataType)).otherwise(F.col("entry")).alias("entry"))

    def column(field: T.StructField):
        text = F.try_element_at("entry", F.lit(field.name.lower()))
        if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            return F.from_json(text, field.dataType, {"mode": "FAILFAST"}).alias(field.name)
        return text.alias(field.name)

    return parsed.select([column(field) for field in schema])


def append_batch(table: str, batch: DataFrame, number: int, batch_column: str | None = None) -> None:
    """Append one micro-batch; with ``batch_column`` as the partition ``number``, whatever that held before."""
    if batch_column is None:
        load_into(table, batch)
        return
    spark = batch.sparkSession
    target = T.StructType([field for field in spark.table(table).schema if field.name != batch_column])
    spark.sql(
        f"INSERT OVERWRITE {table} PARTITION (`{batch_column}` = {int(number)}) SELECT * FROM {{batch}}",
        batch=fitted(batch, target),
    )
