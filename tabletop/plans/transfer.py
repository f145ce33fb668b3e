"""Registered queries for sources and sinks: tables go out to files and come back through the reader under test."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletop.operators.export import export_csv, export_json, read_export
from tabletop.operators.collections import profile_collections
from tabletop.operators.load import load_file, load_into
from tabletop.operators.snapshots import (
    delete_snapshot,
    list_snapshots,
    read_snapshot,
    restore_working,
    total_storage,
    write_snapshot,
    write_working,
)
from tabletop.operators.state import described, read_state
from tabletop.plans.register import registered
from tabletop.plans.tables import table
from tabletop.session import working_folder
from tabletop.sources.documents import read_documents
from tabletop.sources.files import read_csv, read_json
from tabletop.sources.schema import create_table, infer_schema
from tabletop.sources.workbooks import named_rows, parse_workbooks
from tabletop.streaming.ingest import ingest_incremental


def new_database(spark: SparkSession) -> str:
    """An empty database of its own in the shared folder."""
    path = working_folder(spark, "database")
    name = f"work_{path[-32:]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{path}'")
    return name


@registered(
    "s4_read_documents",
    """SELECT event_id, ts, value, CAST(JSON_EXTRACT(props, '$.k') AS BIGINT) AS k, props, event_type, user_id FROM events""",
)
def documents_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = working_folder(spark, "documents")
    events = table(spark, folder, "events")
    # Every column, and props twice: as an object and as the text it was.
    ts, parsed = F.col("ts").cast("string").alias("ts"), F.parse_json("props").alias("props")
    body = F.to_json(F.struct("event_id", "user_id", "event_type", ts, "value", parsed, F.col("props").alias("text")))
    events.select(body.alias("value")).write.text(path)
    docs = read_documents(spark, path)

    def field(place: str, kind: str):
        return F.variant_get("doc", place, kind)

    return docs.select(
        field("$.event_id", "bigint").alias("event_id"),
        field("$.ts", "string").cast(events.schema["ts"].dataType).alias("ts"),
        field("$.value", "double").alias("value"),
        field("$.props.k", "bigint").alias("k"),
        field("$.text", "string").alias("props"),
        field("$.event_type", "string").alias("event_type"),
        field("$.user_id", "bigint").alias("user_id"),
    )


@registered(
    "s5_read_csv",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars
       FROM documents""",
)
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with quotes, commas and line breaks; the reader finds out that it must not split these files."""
    path = working_folder(spark, "csv")
    export_csv(table(spark, folder, "documents"), path)
    return read_csv(spark, path)


@registered("s5_read_tsv_typed", "SELECT * FROM lineitem")
def tsv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Tab-separated, read under a schema; values without line breaks stay splittable."""
    path = working_folder(spark, "tsv")
    items = table(spark, folder, "lineitem")
    export_csv(items, path, sep="\t")
    return read_csv(spark, path, sep="\t", schema=items.schema)


@registered(
    "s6_read_json",
    """SELECT o_orderkey AS "order_key", o_custkey AS customer, o_orderstatus AS status, o_totalprice AS price,
              CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderpriority AS priority FROM orders""",
)
def json_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Names with blanks, and an order of columns that differs from the alphabet."""
    path = working_folder(spark, "json")
    orders = table(spark, folder, "orders")
    body = F.to_json(F.struct(
        F.col("o_orderkey").alias("order key"),
        F.col("o_custkey").alias(" customer "),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderdate").cast("date").cast("string").alias("day"),
        F.col("o_orderpriority").alias("priority"),
    ))
    by_line = F.col("o_orderkey") % 3 > 0
    orders.where(by_line).select(body.alias("value")).write.text(f"{path}/lines")
    # Each of these files is one array over many lines, of rows that follow one another in a task; there are more of them for more rows.
    rows = orders.where(~by_line).withColumn("part", F.floor(F.monotonically_increasing_id() / 8192))
    arrays = rows.groupBy("part").agg(F.concat(
        F.lit("[\n"), F.array_join(F.collect_list(body), ",\n"), F.lit("\n]")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(f"{path}/arrays")
    return read_json(spark, [f"{path}/lines", f"{path}/arrays"])


def _workbook(frame: pd.DataFrame) -> bytes:
    """The smallest file a spreadsheet reader accepts: one sheet, text and number cells."""
    def row(values) -> str:
        cells = (
            f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'
            if isinstance(value, str)
            else f"<c><v>{value!r}</v></c>"
            for value in values
        )
        return f"<row>{''.join(cells)}</row>"

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rows = "".join([row(frame.columns)] + [row(values) for values in frame.astype(object).itertuples(index=False)])
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr(
            "xl/workbook.xml",
            f'<workbook {main} xmlns:r="{office}"><sheets><sheet name="a" sheetId="1" r:id="r1"/></sheets></workbook>',
        )
        archive.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            f'<Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        )
        archive.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")
    return buffer.getvalue()


def workbooks_of(df: DataFrame) -> DataFrame:
    """``path``, ``content``: one workbook per Arrow batch of ``df``, so none grows with the table."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"path": [f"batch-{batch.iloc[0, 0]}.xlsx"], "content": [_workbook(batch)]})

    return df.mapInPandas(pack, "path string, content binary")


@registered(
    "s7_read_workbooks",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
              c_acctbal, c_mktsegment FROM customer""",
)
def workbooks_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer")
    rows = named_rows(parse_workbooks(workbooks_of(customers)), customers.columns)
    return rows.withColumn("c_acctbal", F.col("c_acctbal").cast("double"))


_TYPE_CASE = """CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'bigint' WHEN 'DOUBLE' THEN 'double'
                WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE 'string' END"""


@registered(
    "s8_infer_schema",
    f"""SELECT column_name AS "column", {_TYPE_CASE} AS type FROM (DESCRIBE lineitem)""",
)
def inferred_types(spark: SparkSession, folder: str) -> DataFrame:
    """Types found again after the table went through text."""
    items = table(spark, folder, "lineitem")
    texts = items.select([F.col(name).cast("string").alias(name) for name in items.columns])
    found = infer_schema(texts)
    rows = [(field.name, field.dataType.simpleString()) for field in found]
    return spark.createDataFrame(rows, "column string, type string")


@registered("s9_load_into", "SELECT * FROM orders UNION ALL SELECT * FROM orders")
def loaded_table(spark: SparkSession, folder: str) -> DataFrame:
    """A table made from an inferred schema and filled twice by position from text files."""
    path = working_folder(spark, "load")
    orders = table(spark, folder, "orders")
    export_csv(orders, path)
    texts = read_csv(spark, path)
    database = new_database(spark)
    create_table(spark, f"{database}.orders", infer_schema(texts))
    load_into(f"{database}.orders", texts)
    load_into(f"{database}.orders", orders)
    return spark.table(f"{database}.orders")


@registered("s9_load_file", "SELECT * FROM customer UNION ALL SELECT * FROM customer")
def loaded_file(spark: SparkSession, folder: str) -> DataFrame:
    """From files to a table in one step, twice: the first call makes the table."""
    path = working_folder(spark, "load") + ".csv"
    export_csv(table(spark, folder, "customer"), path)
    name = f"{new_database(spark)}.people"
    load_file(spark, path, name)
    return load_file(spark, path, name)


@registered(
    "p6_collection_profile",
    """SELECT 'events' AS "table", COUNT(*) AS row_count, CAST(MIN(event_id) AS VARCHAR) AS first_pk,
              CAST(MAX(event_id) AS VARCHAR) AS last_pk, '_id:int,event_type:str,props:dict,ts:str,user_id:int,value:float' AS fields,
              '_id' AS primary_key FROM events""",
)
def collection_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Events as exported documents."""
    path = working_folder(spark, "documents")
    body = F.struct(
        F.col("event_id").alias("_id"), F.col("ts").cast("string").alias("ts"), "user_id", "event_type", "value",
        F.parse_json("props").alias("props"))
    table(spark, folder, "events").select(F.to_json(body).alias("value")).write.text(path)
    profile = profile_collections({"events": read_documents(spark, path)})
    entries = F.transform("columns", lambda name: F.concat(name, F.lit(":"), F.element_at("column_types", name)))
    return profile.select(
        "table", "row_count", "first_pk", "last_pk", F.array_join(entries, ",").alias("fields"),
        F.array_join("primary_keys", ",").alias("primary_key"))


@registered(
    "s10_export_csv",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, ts, CAST(user_id AS VARCHAR) AS user_id, event_type, value, props,
              CASE WHEN value > 10 THEN 'True' ELSE 'False' END AS is_high,
              NULLIF(event_type, 'view') AS other_type FROM events""",
)
def csv_export(spark: SparkSession, folder: str) -> DataFrame:
    path = working_folder(spark, "export")
    events = table(spark, folder, "events")
    is_high = (F.col("value") > 10).alias("is_high")
    other = F.nullif("event_type", F.lit("view")).alias("other_type")
    export_csv(events.select("event_id", "ts", "user_id", "event_type", "value", "props", is_high, other), path)
    # What is read back is text; moments and floats must be the same ones.
    back = read_csv(spark, path)
    return back.withColumns({name: F.col(name).cast(events.schema[name].dataType) for name in ("ts", "value")})


@registered(
    "s11_export_json",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_totalprice,
              CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority,
              CASE WHEN o_totalprice > 100000 THEN 'true' ELSE 'false' END AS is_large,
              NULLIF(o_orderpriority, '5-LOW') AS priority FROM orders""",
)
def json_export(spark: SparkSession, folder: str) -> DataFrame:
    path = working_folder(spark, "export")
    orders = table(spark, folder, "orders")
    large = (F.col("o_totalprice") > 100000).alias("is_large")
    priority = F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority")
    export_json(orders.select("*", large, priority), path)
    return read_export(spark, path).withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


@registered(
    "s12_write_snapshot",
    """SELECT l_returnflag, l_linestatus, COUNT(*) AS items, SUM(l_quantity) AS quantity FROM lineitem GROUP BY ALL""",
)
def snapshot_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Written twice: the second run replaces the first although it reads from it."""
    root = working_folder(spark, "snapshots")
    write_snapshot(table(spark, folder, "lineitem"), root, "sales")
    grouped = read_snapshot(spark, root, "sales").groupBy("l_returnflag", "l_linestatus")
    write_snapshot(grouped.agg(F.count("*").alias("items"), F.sum("l_quantity").alias("quantity")), root, "sales")
    return read_snapshot(spark, root, "sales")


@registered("s13_ingest_incremental", "SELECT * FROM orders")
def ingested_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files that arrive in two portions; the second and a third, empty run add only what is new."""
    orders = table(spark, folder, "orders")
    database, inbox, notes = new_database(spark), working_folder(spark, "inbox"), working_folder(spark, "notes")
    create_table(spark, f"{database}.orders", orders.schema)
    is_old = F.col("o_orderdate") < F.to_timestamp_ntz(F.lit("1998-01-01"))
    for portion in (orders.where(is_old), orders.where(~is_old)):
        lines = portion.select([F.col(name).cast("string").alias(name) for name in orders.columns])
        lines.write.mode("append").option("header", True).csv(inbox)
        ingest_incremental(spark, inbox, f"{database}.orders", notes)
    return ingest_incremental(spark, inbox, f"{database}.orders", notes)


@registered("s13_ingest_json_layouts", "SELECT * FROM events")
def ingested_json(spark: SparkSession, folder: str) -> DataFrame:
    """Files of lines, then files that are one array each, into one table."""
    events = table(spark, folder, "events")
    database, inbox, notes = new_database(spark), working_folder(spark, "inbox"), working_folder(spark, "notes")
    create_table(spark, f"{database}.events", events.schema)
    line = F.to_json(F.struct(*[F.col(name).cast("string").alias(name) for name in events.columns]))
    some = events.where("event_id % 3 = 0").select(line.alias("value"))
    some.write.mode("append").text(inbox)
    ingest_incremental(spark, inbox, f"{database}.events", notes, file_format="json")
    # One array for each ten thousand ids, every array a file.
    others = events.where("event_id % 3 <> 0").groupBy(F.floor(F.col("event_id") / 10_000).alias("part")).agg(F.collect_list(line).alias("lines"))
    arrays = others.select(F.concat(F.lit("["), F.array_join("lines", ",\n"), F.lit("]")).alias("value"))
    arrays.write.mode("append").option("maxRecordsPerFile", 1).text(f"{inbox}-arrays")
    return ingest_incremental(spark, f"{inbox}-arrays", f"{database}.events", f"{notes}-arrays", file_format="json")


_REFRESHED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@registered(
    "s13_refreshed_profile",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS "column", COUNT(*) AS row_count, COUNT(*) - COUNT({name}) AS null_count,
                   CASE WHEN COUNT(DISTINCT {name}) < 50 THEN COUNT(DISTINCT {name}) END AS few_distinct,
                   MIN({name})::VARCHAR AS low, MAX({name})::VARCHAR AS high FROM orders"""
        for name in _REFRESHED
    ),
)
def refreshed_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of the columns of a table after two portions of files, of which each call read only its own."""
    orders = table(spark, folder, "orders")
    database, inbox, notes = new_database(spark), working_folder(spark, "inbox"), working_folder(spark, "notes")
    known = working_folder(spark, "profile")
    create_table(spark, f"{database}.orders", orders.schema)
    is_old = F.col("o_orderdate") < F.to_timestamp_ntz(F.lit("1998-01-01"))
    for portion in (orders.where(is_old), orders.where(~is_old)):
        lines = portion.select([F.col(name).cast("string").alias(name) for name in orders.columns])
        lines.write.mode("append").option("header", True).csv(inbox)
        ingest_incremental(spark, inbox, f"{database}.orders", notes, profile=known)
    facts = described(read_state(spark, known), orders.schema)
    few = F.when(F.col("distinct") < 50, F.col("distinct")).alias("few_distinct")
    return facts.select("column", "row_count", "null_count", few, "low", "high")


def _stored(spark: SparkSession, folder: str) -> str:
    root = working_folder(spark, "snapshots")
    for name in ("orders", "events", "documents"):
        write_snapshot(table(spark, folder, name), root, name)
    return root


@registered(
    "n1_list_snapshots",
    """SELECT t.name, 'source.parquet' AS file, t.n > 0 AS has_bytes, true AS memory_safe
       FROM (SELECT 'orders' AS name, COUNT(*) AS n FROM orders UNION ALL SELECT 'events', COUNT(*) FROM events
             UNION ALL SELECT 'documents', COUNT(*) FROM documents) t""",
)
def snapshot_listing(spark: SparkSession, folder: str) -> DataFrame:
    """The sizes themselves depend on the writer; tests check them against the files."""
    listing = list_snapshots(spark, _stored(spark, folder))
    return listing.select("name", "file", (F.col("size_bytes") > 0).alias("has_bytes"), "memory_safe")


@registered("n3_total_storage")
def storage(spark: SparkSession, folder: str) -> DataFrame:
    return total_storage(list_snapshots(spark, _stored(spark, folder)))


@registered("n5_delete_snapshot", "SELECT t.name, t.n FROM (SELECT 'events' AS name, COUNT(*) AS n FROM events UNION ALL SELECT 'documents', COUNT(*) FROM documents) t")
def remaining_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Three are kept, one is removed; the rows of those left."""
    root = _stored(spark, folder)
    delete_snapshot(spark, root, "orders")
    names = [row.name for row in list_snapshots(spark, root).collect()]
    counts = [read_snapshot(spark, root, name).agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name in names]
    return counts[0].union(counts[1])


@registered("n4_restore_working", "SELECT * FROM customer")
def restored_copy(spark: SparkSession, folder: str) -> DataFrame:
    """A working copy is made, changed and set back."""
    root = working_folder(spark, "snapshots")
    write_snapshot(table(spark, folder, "customer"), root, "people")
    restore_working(spark, root, "people")
    working = read_snapshot(spark, root, "people", working=True)
    write_working(working.where("c_acctbal > 0").withColumn("c_name", F.upper("c_name")), root, "people")
    restore_working(spark, root, "people")
    return read_snapshot(spark, root, "people", working=True)
