import datetime
import random
from decimal import Decimal

import pytest
from conftest import plan_of, values
from pyspark.sql import functions as F
from pyspark.sql import types as T
from workbook_files import write_workbook

from tabletop.functions.text import clean_names
from tabletop.operators.export import export_csv, export_json, read_export
from tabletop.operators.load import load_into
from tabletop.plans import registry
from tabletop.plans.transfer import new_database
from tabletop.sources import jdbc
from tabletop.sources.documents import read_documents
from tabletop.sources.files import read_csv, read_json
from tabletop.sources.schema import create_table, infer_schema
from tabletop.sources.workbooks import parse_workbooks, read_workbooks


def test_csv_quotes_breaks_nulls(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('a,b,c\n1,"",\n2,"x ""q""\nnext, line",y\n3,,"z"\n', encoding="utf-8")
    assert values(read_csv(spark, str(path))) == [("1", "", None), ("2", 'x "q"\nnext, line', "y"), ("3", None, "z")]


def test_csv_without_breaks_stays_splittable(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("a,b\n" + "".join(f'{i},"v ""{i}"""\n' for i in range(2000)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_csv(spark, str(path))
        assert df.rdd.getNumPartitions() > 3
        assert values(df) == sorted([(str(i), f'v "{i}"') for i in range(2000)], key=repr)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("breaks", [True, False])
def test_csv_round_trip_of_awkward_texts(spark, tmp_path, breaks):
    random.seed(4)
    alphabet = ['"', ",", "a", " ", "\\", "'", "#", "é", "\t", "0"] + (["\n", "\r\n"] if breaks else [])
    texts = ["".join(random.choices(alphabet, k=random.randrange(6))) for _ in range(600)]
    rows = [(i, text if i % 7 else None, text[::-1]) for i, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, a string, b string").repartition(3)
    export_csv(df, str(tmp_path / "out"))
    assert values(read_csv(spark, str(tmp_path / "out"))) == sorted([(str(i), a, b) for i, a, b in rows], key=repr)
    export_json(df, str(tmp_path / "json"))
    assert values(read_export(spark, str(tmp_path / "json"))) == sorted([(str(i), a, b) for i, a, b in rows], key=repr)


def test_tsv_with_schema_and_bad_value(spark, tmp_path):
    good, bad = tmp_path / "good.txt", tmp_path / "bad.txt"
    good.write_text("id\ttitle\tshare\n1\ta, b\t0.5\n2\t\t\n", encoding="utf-8")
    bad.write_text("id\ttitle\tshare\nx\ta\t0.5\n", encoding="utf-8")
    schema = "id bigint, title string, share double"
    assert values(read_csv(spark, str(good), sep="\t", schema=schema)) == [(1, "a, b", 0.5), (2, None, None)]
    with pytest.raises(Exception, match="(?i)malformed|cannot parse|x"):
        read_csv(spark, str(bad), sep="\t", schema=schema).collect()


def test_csv_wrong_number_of_fields_is_an_error(spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_text("a,b,c\n1,2,3\n4,5\n", encoding="utf-8")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_csv(spark, str(path)).collect()


def test_json_lines_keep_file_order_and_clean_names(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('{"z key": 1, " b ": "x"}\n{"z key": 2, "a": [1], " b ": null}\n', encoding="utf-8")
    df = read_json(spark, str(path))
    assert df.columns == ["z_key", "b", "a"]
    assert values(df) == [(1, "x", None), (2, None, [1])]


def test_json_array_and_columns_document(spark, tmp_path):
    array, columns, broken = tmp_path / "array.json", tmp_path / "columns.json", tmp_path / "broken.json"
    array.write_text('[\n {"n": 1,\n  "a": "x"},\n {"n": 2, "a": null}\n]', encoding="utf-8")
    columns.write_text('{"n": [1, 2],\n "a": ["x", "y"]}', encoding="utf-8")
    broken.write_text('{"n": 1,\n oops', encoding="utf-8")
    df = read_json(spark, str(array))
    assert df.columns == ["n", "a"] and values(df) == [(1, "x"), (2, None)]
    df = read_json(spark, str(columns))
    assert df.columns == ["n", "a"] and values(df) == [(1, "x"), (2, "y")]
    with pytest.raises(Exception):
        read_json(spark, str(broken)).collect()


def test_clean_names():
    assert clean_names([" a b ", "user", 3], ["USER"]) == ["a_b", "user_col", "3"]
    with pytest.raises(ValueError, match="clash"):
        clean_names(["a b", "A_B"])


def test_documents_keep_mixed_types(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text('{"a": 1}\n{"a": "x", "b": {"c": [1]}}\n', encoding="utf-8")
    docs = read_documents(spark, str(path))
    got = docs.select(F.variant_get("doc", "$.a", "string").alias("a"), F.expr("variant_get(doc, '$.b.c[0]', 'int')"))
    assert values(got) == [("1", None), ("x", 1)]


def _cell(value, kind="n", style=None, ref=None):
    attributes = f' t="{kind}"' + (f' s="{style}"' if style is not None else "") + (f' r="{ref}"' if ref else "")
    return f"<c{attributes}><v>{value}</v></c>"


def test_workbooks(spark, tmp_path):
    shared = ["<t>name</t>", "<t>day</t>", "<t>n</t>", "<r><t>Ann</t></r><r><t> B</t></r>", '<t>a "b", c\nd</t>', "<t>flag</t>"]
    head = "<row>" + "".join(_cell(i, "s") for i in (0, 1, 2, 5)) + "</row>"
    rows = (
        head
        + f'<row r="2">{_cell(3, "s")}{_cell(43831, style=1)}{_cell("7")}{_cell(1, "b")}</row>'
        + f'<row r="4">{_cell(4, "s", ref="A4")}<c r="C4"><f>1+1</f><v>2.5</v></c></row>'
        + f'<row r="5">{_cell("", "str")}{_cell(0.5, style=2)}{_cell("1E3", style=3)}{_cell(0, "b")}</row>'
    )
    write_workbook(tmp_path / "one.xlsx", ["<row/>", rows], active=1, shared=shared, formats=(0, 164, 20, 165))
    second = head + f'<row>{_cell(3, "s")}{_cell(59.25, style=1)}{_cell("-4")}{_cell(1, "b")}</row>'
    write_workbook(tmp_path / "two.xlsx", [second], shared=shared, formats=(0, 14))
    df = read_workbooks(spark, str(tmp_path / "*.xlsx"))
    assert df.columns == ["name", "day", "n", "flag"]
    assert values(df) == sorted(
        [
            ("Ann B", "2020-01-01 00:00:00", "7", "True"),
            (None, None, None, None),
            ('a "b", c\nd', None, "2.5", None),
            (None, "12:00:00", "1000.0", "False"),
            ("Ann B", "1900-02-28 06:00:00", "-4", "True"),
        ],
        key=repr,
    )


def test_workbooks_that_do_not_fit(spark, tmp_path):
    def row(*values):
        return "<row>" + "".join(_cell(value) for value in values) + "</row>"

    write_workbook(tmp_path / "a.xlsx", [row(1, 2) + row(3, 4, 5)])
    write_workbook(tmp_path / "b.xlsx", [row(9, 8) + row(3, 4)])
    with pytest.raises(ValueError, match="headers"):
        read_workbooks(spark, str(tmp_path / "*.xlsx"))
    with pytest.raises(Exception, match="more than 2 cells"):
        read_workbooks(spark, str(tmp_path / "*.xlsx"), ["x", "y"]).collect()
    assert values(read_workbooks(spark, str(tmp_path / "b.xlsx"), ["x", "y"])) == [("3", "4")]


def test_workbook_dates_from_1904(spark, tmp_path):
    write_workbook(tmp_path / "m.xlsx", [f"<row>{_cell(0)}</row><row>{_cell(1, style=1)}</row>"], formats=(0, 14), date_1904=True)
    cells = parse_workbooks(spark.read.format("binaryFile").load(str(tmp_path / "m.xlsx")))
    assert [row["cells"] for row in cells.orderBy("row_no").collect()] == [["0"], ["1904-01-02 00:00:00"]]


def test_infer_schema(spark):
    df = spark.createDataFrame(
        [
            ("1", "1.5", "true", "2024-01-31", "2024-01-31 10:00:00", "x", "", "9999999999999999999"),
            ("-2", "3", "False", "2024-02-29", "2024-02-29", "1", None, "1"),
            (None, "1e-3", None, None, None, None, None, None),
        ],
        "`my id` string, share string, user string, d string, t string, mixed string, empty string, big string",
    )
    expected = {
        "my_id": "bigint", "share": "double", "user_col": "boolean", "d": "date", "t": "timestamp_ntz",
        "mixed": "string", "empty": "string", "big": "decimal(38,0)",
    }
    assert {f.name: f.dataType.simpleString() for f in infer_schema(df)} == expected
    late = spark.range(100).select(F.when(F.col("id") < 99, F.col("id").cast("string")).otherwise("x").alias("v"))
    assert infer_schema(late)["v"].dataType == T.StringType()
    wrong_day = spark.createDataFrame([("2023-02-30",)], "d string")
    assert infer_schema(wrong_day)["d"].dataType == T.StringType()


def test_inferred_types_keep_every_value(spark):
    columns = {
        "zeros": (["007", "1"], "string"), "plus": (["+1", "2"], "string"), "minus_zero": (["-0"], "string"),
        "ids": (["12345678901234567890", "12345678901234567891"], "decimal(38,0)"), "huge": (["1" * 39], "string"),
        "edge": (["9223372036854775807", "-9223372036854775808"], "bigint"), "precise": (["0.1234567890123456789"], "string"),
        "exact": (["0.30000000000000004", "1"], "double"), "joint": (["123456789012345678", "1.5"], "string"),
        "offset": (["2024-01-01 00:00:00+02:00"], "timestamp"), "mixed_offset": (["2024-01-01 00:00:00Z", "2024-01-01 00:00:00"], "string"),
        "nanos": (["2024-01-01 00:00:00.123456789"], "string"), "blank": (["1", ""], "string"), "point": (["1.", "2"], "string"),
    }
    for name, (texts, expected) in columns.items():
        df = spark.createDataFrame([(text,) for text in texts], f"{name} string")
        schema = infer_schema(df)
        assert schema[0].dataType.simpleString() == expected, name
        table = f"{new_database(spark)}.t"
        create_table(spark, table, schema)
        load_into(table, df)
        # A reserved word gets another name as a column.
        assert spark.table(table).count() == len(texts) and spark.table(table).where(F.col(schema[0].name).isNull()).isEmpty()


def test_load_refuses_what_it_would_change(spark):
    database = new_database(spark)
    for i, (kind, given, value) in enumerate([
        ("bigint", "double", 1.9), ("date", "timestamp", datetime.datetime(2024, 1, 1, 23, 59, 59)),
        ("decimal(10,1)", "decimal(10,2)", Decimal("1.26")), ("int", "bigint", 2**40), ("float", "double", 0.1),
        ("decimal(10,1)", "string", "1.26"), ("date", "string", "2024-01-01 10:00:00"), ("bigint", "string", ""),
    ]):
        name = f"{database}.t{i}"
        spark.sql(f"CREATE TABLE {name} (v {kind}) USING parquet")
        with pytest.raises(Exception, match="cannot hold"):
            load_into(name, spark.createDataFrame([(value,)], f"v {given}"))
        assert spark.table(name).count() == 0
    name = f"{database}.fits"
    spark.sql(f"CREATE TABLE {name} (a bigint, b date, c decimal(10,1), d float, e string) USING parquet")
    row = (2.0, datetime.datetime(2024, 1, 1), Decimal("1.20"), 0.5, 7)
    load_into(name, spark.createDataFrame([row, (None,) * 5], "a double, b timestamp, c decimal(10,2), d double, e int"))
    assert values(spark.table(name)) == [(2, datetime.date(2024, 1, 1), Decimal("1.2"), 0.5, "7"), (None,) * 5]


def test_one_column_with_nulls_and_empty_texts(spark, tmp_path):
    rows = [(None,), ("",), ("x",), (None,), ("a\nb",)]
    export_csv(spark.createDataFrame(rows, "v string"), str(tmp_path / "one"))
    assert values(read_csv(spark, str(tmp_path / "one"))) == sorted(rows, key=repr)
    numbers = spark.range(10).select(F.when(F.col("id") != 3, F.col("id")).alias("id"))
    export_csv(numbers, str(tmp_path / "numbers"))
    assert read_csv(spark, str(tmp_path / "numbers")).count() == 10


def test_one_bad_csv_file_leaves_the_others_split(spark, tmp_path):
    folder = tmp_path / "some files"
    folder.mkdir()
    (folder / "long.csv").write_text("a,b\n" + "".join(f'{i},5" pipe {i}\n' for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        split = read_csv(spark, str(folder)).rdd.getNumPartitions()
        assert split > 5
        (folder / "breaks.csv").write_text('a,b\nx,"one\ntwo, ""three"""\n')
        df = read_csv(spark, str(folder))
        assert df.rdd.getNumPartitions() >= split and df.count() == 3001
        assert values(df.where("a = 'x'")) == [("x", 'one\ntwo, "three"')]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (folder / "swapped.csv").write_text("b,a\n1,2\n")
    with pytest.raises(Exception, match="(?i)header|columns"):
        read_csv(spark, str(folder)).collect()


def test_json_layouts_may_mix_and_no_row_is_lost(spark, tmp_path):
    folder = tmp_path / "mixed json"
    folder.mkdir()
    (folder / "a.json").write_text('[\n {"n": 1, "x": "p"},\n {"n": 2, "x": null}\n]')
    (folder / "b.json").write_text('\n{"n": 3}\n{"n": 4.5, "late": true}\n\n{"n": 5}\n')
    (folder / "c.json").write_text('{"n": [6, 7],\n "x": ["q", "r"]}')
    (folder / "d.json").write_text('{"n": 8,\n "x": "s"}')
    df = read_json(spark, str(folder))
    assert sorted(df.columns) == ["late", "n", "x"]
    assert sorted((r.n, r.x, r.late) for r in df.collect()) == [
        (1.0, "p", None), (2.0, None, None), (3.0, None, None), (4.5, None, True), (5.0, None, None), (6.0, "q", None),
        (7.0, "r", None), (8.0, "s", None)]
    for name, content in (("lines.json", '{"n": 1}\n{"n": oops\n{"n": 3}\n'), ("two.json", '[{"n": 1}]\n[{"n": 2}]'),
                          ("pretty.json", '{"n":\n 1}\n{"n":\n 2}')):
        (tmp_path / name).write_text(content)
        with pytest.raises(Exception):
            read_json(spark, str(tmp_path / name)).collect()


def test_load_by_position_all_or_nothing(spark):
    database = new_database(spark)
    name = f"{database}.tracks"
    create_table(spark, name, T._parse_datatype_string("track string, duration int, price decimal(6,2), explicit boolean"))
    load_into(name, spark.createDataFrame([("a", "3", "1.50", "true"), (None, None, None, "f")], "w string, x string, y string, z string"))
    expected = [(None, None, None, False), ("a", 3, Decimal("1.50"), True)]
    assert values(spark.table(name)) == sorted(expected, key=repr)
    bad = spark.range(0, 4000, numPartitions=8).select(
        F.lit("t"), F.when(F.col("id") == 3999, "oops").otherwise(F.col("id").cast("string")), F.lit("1"), F.lit("true")
    )
    with pytest.raises(Exception, match="oops"):
        load_into(name, bad)
    assert spark.table(name).count() == 2
    with pytest.raises(ValueError, match="4 columns"):
        load_into(name, spark.range(1))


PG = {"url": "jdbc:postgresql://host/db"}


def test_jdbc_texts():
    assert jdbc.quoted(PG, "public", 'we"ird') == '"public"."we""ird"'
    assert jdbc.quoted({"url": "jdbc:mysql://h/d"}, "t") == "`t`"
    assert jdbc.quoted({"url": "jdbc:sqlserver://h"}, "dbo", "t") == "[dbo].[t]"
    assert jdbc.bounds_query(PG, "t", "id", "public") == 'SELECT MIN("id") AS low, MAX("id") AS high, COUNT(*) AS total FROM "public"."t"'
    with pytest.raises(ValueError):
        jdbc.vendor({"url": "postgresql://x"})


def test_jdbc_ranges_cover_every_row_once(spark):
    """The WHERE clauses, run over literal rows: each row falls in exactly one range."""
    rows = spark.createDataFrame([(None,), ("",), ("a",), ("b'",), ("m",), ("z",)], "k string")
    rows.createOrReplaceTempView("ranged")
    clauses = [clause.replace('"', "`") for clause in jdbc.range_predicates(PG, "k", ["a", "b'", "m", "m"])]
    assert len(clauses) == 3
    hits = [rows.where(clause.replace("''", "\\'")).count() for clause in clauses]
    assert hits == [3, 1, 2]
    assert jdbc.range_predicates(PG, "k", [5]) == ["1 = 1"]
    assert jdbc.range_predicates(PG, "d", [datetime.date(2024, 1, 1), datetime.date(2025, 1, 1)])[1] == "\"d\" >= '2025-01-01'"


def test_lines_are_not_sorted_to_tell_layouts(spark, tmp_path, monkeypatch):
    """What each task keeps of the lines it reads is a number for each file and key."""
    spark.range(300).selectExpr("to_json(struct(id, id % 7 AS `b b`)) AS value").write.text(f"{tmp_path}/lines")
    spark.range(1).selectExpr("'[{\"c\": 1},\\n {\"id\": 5}]' AS value").write.text(f"{tmp_path}/array")
    kind = type(spark.range(1))
    plans, collect = [], kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: (plans.append(plan_of(self)), collect(self))[1])
    found = read_json(spark, [f"{tmp_path}/lines", f"{tmp_path}/array"])
    monkeypatch.undo()
    assert sorted(found.columns) == ["b_b", "c", "id"] and found.count() == 302
    deepest = [[line for line in plan.splitlines() if "Aggregate(" in line][-1] for plan in plans if "Aggregate(" in plan]
    assert len(deepest) == 3 and all("HashAggregate(" in line and "Object" not in line for line in deepest), deepest


def test_arrays_are_as_many_as_the_rows_ask_for(spark, tmp_path):
    spark.range(120_000).selectExpr(
        "id AS o_orderkey", "id AS o_custkey", "'O' AS o_orderstatus", "1.5D AS o_totalprice", "TIMESTAMP_NTZ '2000-01-01' AS o_orderdate",
        "'5-LOW' AS o_orderpriority").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    found = registry.queries()["s6_read_json"](spark, str(tmp_path))
    assert found.count() == 120_000 and found.select("order_key").distinct().count() == 120_000
    arrays = spark.read.text([path for path in found.inputFiles() if "/arrays/" in path])
    sizes = [row["count"] for row in arrays.groupBy("_metadata.file_path").count().collect()]
    assert len(sizes) > 4 and max(sizes) <= 8192 + 2
