import datetime
import random
import re

from decimal import Decimal

import pytest
from conftest import plan_of, values
from pyspark.sql import functions as F

from tabletop.functions.text import size_text
from tabletop.functions.time import grain_number
from tabletop.operators import (
    asof_join,
    assemble,
    check_reference,
    database_totals,
    delete_snapshot,
    discover_keys,
    discover_references,
    execute,
    export_json,
    field_types,
    keys_from_catalog,
    last_messages,
    list_snapshots,
    preview,
    profile_tables,
    range_join,
    read_export,
    read_snapshot,
    restore_working,
    rows_as_json,
    split_reply,
    sql,
    table_sizes,
    token_rate,
    total_storage,
    write_snapshot,
    write_working,
)
from tabletop.operators import keys
from tabletop.operators.profile import KEY_COLUMN_SCHEMA, KEY_SCHEMA
from tabletop.plans.transfer import new_database
from tabletop.sources.documents import document_column


def test_preview(spark):
    shown = preview(spark.range(250).orderBy("id"))
    assert (shown.columns, shown.total_rows, shown.preview_count) == (["id"], 250, 100)
    assert [row.id for row in shown.rows.collect()] == list(range(100))
    assert preview(spark.range(3)).preview_count == 3


def test_execute(spark):
    name = f"{new_database(spark)}.t"
    assert execute(spark, f"CREATE TABLE {name} (a INT) USING parquet").collect()[0].Message == "Query executed successfully"
    assert execute(spark, f"INSERT INTO {name} VALUES (1), (2)").columns == ["Message"]
    assert values(execute(spark, f"SELECT a * 2 AS k FROM {name};")) == [(2,), (4,)]


def test_rows_as_json(spark):
    df = spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b, DATE '2024-01-02' AS d, 1.50BD AS m, X'4142' AS x, array(1, 2) AS l")
    assert rows_as_json(df).head().json == '{"a":1,"b":null,"d":"2024-01-02","m":"1.50","x":"QUI=","l":[1,2]}'


def test_size_text(spark):
    sizes = [0, 1023, 1024, 1280, 1434, 1048575, 1048576, 1363149, 1073741823, 1073741824, 5 * 1024**4, None]
    texts = ["0 B", "1023 B", "1.0 KB", "1.2 KB", "1.4 KB", "1024.0 KB", "1.0 MB", "1.3 MB", "1024.0 MB", "1.00 GB", "5120.00 GB", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i int, s bigint")
    assert [row.t for row in df.select("i", size_text(F.col("s")).alias("t")).orderBy("i").collect()] == texts


def test_keys_from_catalog_pairs_composite_references(spark):
    rows = [
        ("line", "pk", "P", 2, "no", None, None), ("line", "pk", "P", 1, "order_id", None, None),
        ("line", "u1", "U", 1, "code", None, None), ("line", "u2", "U", 1, "code", None, None),
        ("line", "f", "F", 1, "a", "head", "x"), ("line", "f", "F", 2, "b", "head", "y"),
        ("head", "pk", "P", 1, "x", None, None), ("head", "pk", "P", 2, "y", None, None),
    ]
    found = {row.table: row for row in keys_from_catalog(spark.createDataFrame(rows, KEY_COLUMN_SCHEMA)).collect()}
    assert found["line"].primary_keys == ["order_id", "no"] and found["line"].unique_keys == ["code"]
    assert [tuple(r) for r in found["line"].foreign_keys] == [("a", "head", "x"), ("b", "head", "y")]
    assert found["head"].foreign_keys == []


def test_profile(spark, tmp_path):
    people = spark.createDataFrame([(2, "b"), (10, "a")], "id int, name string")
    empty = spark.createDataFrame([], "x double")
    people.write.parquet(str(tmp_path / "people"))
    known = spark.createDataFrame([("people", ["id"], ["name", "id"], [])], KEY_SCHEMA)
    sizes = table_sizes(spark, {"people": str(tmp_path / "people")})
    rows = {row.table: row for row in profile_tables({"people": people, "empty": empty}, known, sizes).collect()}
    row = rows["people"]
    assert (row.row_count, row.first_pk, row.last_pk) == (2, "2", "10")
    assert (row.columns, row.column_types) == (["id", "name"], {"id": "int", "name": "string"})
    assert row.candidate_keys == ["id", "name"]
    assert row.size_bytes == sum(f.stat().st_size for f in (tmp_path / "people").glob("part-*"))
    assert (rows["empty"].row_count, rows["empty"].first_pk, rows["empty"].primary_keys) == (0, None, [])
    totals = database_totals(profile_tables({"people": people, "empty": empty}).withColumn("database", F.lit("d")))
    assert values(totals.select("database", "table_count", "total_columns", "total_rows")) == [("d", 2, 3, 2), (None, 2, 3, 2)]


def test_discover_keys(spark):
    rows = [(i, i // 2, i % 2, None if i == 5 else i, "x") for i in range(400)]
    df = spark.createDataFrame(rows, "id int, half int, side int, gap int, same string")
    no_id = df.drop("id")
    found = discover_keys({"a": df, "b": no_id, "c": no_id.drop("half"), "d": df.limit(0)})
    assert found == {"a": [("id",)], "b": [("half", "side")], "c": [], "d": []}
    assert discover_keys({"b": no_id}, 1) == {"b": []}


def test_sample_only_rules_out(spark, monkeypatch):
    """With the sample in use the keys found are the same, also where only two rows of many agree."""
    df = spark.range(3000).select("id", F.when(F.col("id") == 7, 8).otherwise(F.col("id")).alias("nearly"))
    with pytest.raises(ValueError, match="max_width"):
        keys.discover_keys({"t": df}, max_width=3)
    long = df.select(F.concat(F.lit("x" * 100), F.col("id").cast("string")).alias("long"))
    assert keys.discover_keys({"t": long}) == {"t": [("long",)]}
    monkeypatch.setattr(keys, "_PAIRS_A_PASS", 1)
    assert keys.discover_keys({"t": df}) == {"t": [("id",)]}
    assert keys.discover_keys({"t": df.select("nearly", (F.col("id") % 50).alias("m"))}) == {"t": [("nearly", "m")]}


def test_references_against_brute_force(spark):
    random.seed(5)
    parent = [(i, f"c{i}") for i in range(0, 60, 2)]
    hot = [(2, "c2")] * 400
    child = hot + [(random.choice(range(0, 60, 2)), f"c{random.choice(range(0, 60, 2))}") for _ in range(200)] + [(None, "c0")]
    stray = [(v, "zz") for v in (4, 5, 8)]
    frames = {
        "p": spark.createDataFrame(parent, "id int, code string"),
        "c": spark.createDataFrame(child, "ref bigint, tag string"),
        "s": spark.createDataFrame(stray, "ref int, tag string"),
    }
    data = {("p", "id"): [r[0] for r in parent], ("p", "code"): [r[1] for r in parent], ("c", "ref"): [r[0] for r in child],
            ("c", "tag"): [r[1] for r in child], ("s", "ref"): [r[0] for r in stray], ("s", "tag"): [r[1] for r in stray]}
    expected = []
    for (table, column), cells in data.items():
        for key in ("id", "code"):
            cells_set = {c for c in cells if c is not None}
            if table != "p" and cells_set <= set(data["p", key]):
                expected.append((table, column, "p", key, sum(c is not None for c in cells)))
    assert values(discover_references(frames, {"p": ["id", "code"]})) == sorted(expected, key=repr)
    assert len(expected) == 2
    assert tuple(check_reference(frames["s"], "ref", frames["p"], "id").head()) == (3, 1, 1)
    assert tuple(check_reference(frames["c"], "ref", frames["p"], "id").head()) == (600, 0, 0)


def test_field_types(spark):
    docs = ['{"a": 1, "b": {"x": 1}}', '{"a": "x", "b": {"y": [2]}}', '{"a": null, "c": [1, "z"], "d": 1.5, "e": true}']
    df = spark.createDataFrame([(d,) for d in docs], "j string").select(document_column("j").alias("doc")).coalesce(1)
    got = {row.field: (row.types, row.present) for row in field_types(df).collect()}
    assert got == {
        "a": (["NoneType", "int", "str"], 3), "b": (["dict"], 2), "c": (["list"], 1), "d": (["float"], 1), "e": (["bool"], 1)
    }
    late = spark.range(100).select(F.when(F.col("id") < 50, '{"a": 1}').otherwise('{"a": "x", "b": 2}').alias("j"))
    found = field_types(late.select(document_column("j").alias("doc")))
    assert {row.field: (row.type, row.present) for row in found.collect()} == {"a": ("int,str", 100), "b": ("int", 50)}


def test_snapshots(spark, tmp_path):
    root = str(tmp_path)
    (tmp_path / "no-source").mkdir()
    assert list_snapshots(spark, root).count() == 0
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("m"), F.lit(None).alias("nothing"))
    path = write_snapshot(df, root, "first one")
    write_snapshot(read_snapshot(spark, root, "first one").where("m = 3"), root, "first one")
    assert read_snapshot(spark, root, "first one").count() == 143
    write_snapshot(df.limit(0), root, "empty")
    assert read_snapshot(spark, root, "empty").schema["nothing"].dataType.simpleString() == "string"
    restore_working(spark, root, "first one")
    write_working(read_snapshot(spark, root, "first one", working=True).limit(1), root, "first one")
    assert read_snapshot(spark, root, "first one", working=True).count() == 1
    restore_working(spark, root, "first one")
    assert read_snapshot(spark, root, "first one", working=True).count() == 143
    listing = {row.name: row for row in list_snapshots(spark, root).collect()}
    assert set(listing) == {"first one", "empty"}
    on_disk = sum(f.stat().st_size for f in (tmp_path / "first one" / "source.parquet").glob("part-*"))
    assert listing["first one"].size_bytes == on_disk and listing["first one"].memory_safe
    assert path.endswith("first one/source.parquet")
    total = total_storage(list_snapshots(spark, root)).head()
    assert total.size_bytes == sum(row.size_bytes for row in listing.values())
    assert not [p.name for p in (tmp_path / "first one").iterdir() if p.name.startswith("_")]


def test_snapshot_refusals(spark, tmp_path):
    twice = spark.range(1).select("id", F.col("id").alias("ID"))
    with pytest.raises(ValueError, match="more than once"):
        write_snapshot(twice, str(tmp_path), "x")
    for name in ("..", "a/b", "", ".hidden", "_x", "a*"):
        with pytest.raises(ValueError):
            write_snapshot(spark.range(1), str(tmp_path), name)
    write_snapshot(spark.range(5), str(tmp_path), "kept")
    broken = spark.range(5).select(F.raise_error(F.lit("no")).cast("string").alias("v"))
    with pytest.raises(Exception):
        write_snapshot(broken, str(tmp_path), "kept")
    assert read_snapshot(spark, str(tmp_path), "kept").count() == 5


def test_json_export_layout(spark, tmp_path):
    df = spark.sql("SELECT 1 AS a, 'x\"y' AS b, CAST(NULL AS INT) AS c, 2.5D AS d, true AS e, 1.10BD AS f, map('k', 1) AS g")
    export_json(df, str(tmp_path / "out"))
    rows = spark.read.text(str(tmp_path / "out" / "rows")).head().value
    assert rows == '[1,"x\\"y",null,2.5,true,"1.10",{"k":1}]'
    assert spark.read.text(str(tmp_path / "out" / "headers")).head().value == '["a","b","c","d","e","f","g"]'
    back = read_export(spark, str(tmp_path / "out"))
    assert back.columns == df.columns and tuple(back.head()) == ("1", 'x"y', None, "2.5", "true", "1.10", '{"k":1}')


def test_last_messages_of_a_huge_conversation(spark):
    rows = [(1, i, "t") for i in range(5000)] + [(c, i, "t") for c in range(2, 40) for i in range(c)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, text string").repartition(8)
    got = last_messages(df)
    counts = dict(values(got.groupBy("conv_id").count()))
    assert counts == {1: 20, **{c: min(c, 20) for c in range(2, 40)}}
    assert got.where("conv_id = 1").agg(F.min("turn")).head()[0] == 4980
    before_shuffle = plan_of(got).split("Exchange hashpartitioning")[1]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle


def test_split_reply(spark):
    cases = [
        ("<query>SELECT * FROM users;</query><comment>All.</comment>", "SELECT * FROM users;", "All."),
        ("<query></query><comment>\n hello\nthere </comment>", "", "hello\nthere"),
        ("<query>SELECT 1", "SELECT 1", None),
        ("<query>SELECT a\nFROM t</query> x <comment>so far", "SELECT a\nFROM t", "so far"),
        ("plain text", None, None),
        ("</query> stray <comment>c</query></comment>", None, "c"),
        ("<query>a</query><query>b</query>", "a\n\nb", None),
        ("<query>a</query> then <query>b", "a\n\nb", None),
        (None, None, None),
    ]
    df = spark.createDataFrame([(i, text) for i, (text, _, _) in enumerate(cases)], "i int, text string")
    got = [(row.query, row.comment) for row in split_reply(df).orderBy("i").collect()]
    assert got == [(query, comment) for _, query, comment in cases]


def test_assemble(spark):
    random.seed(3)
    chunks = [(r, s, random.choice(["a", "Wort ", "\n", "", "é"])) for r in range(5) for s in range(1 + 700 * (r == 2) + r)]
    expected = {r: "".join(t for q, _, t in chunks if q == r) for r in range(5)}
    random.shuffle(chunks)
    df = spark.createDataFrame(chunks, "reply int, seq int, token string").repartition(4)
    for size in (1, 7, 10_000):
        assert dict(values(assemble(df, ["reply"], chunks_per_piece=size))) == expected


def test_token_rate(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(1, start), (1, start + datetime.timedelta(milliseconds=1500)), (1, start + datetime.timedelta(milliseconds=400)), (2, start)]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz")
    assert values(token_rate(df, ["k"])) == [(1, 3, 1.5, 2.0), (2, 1, 0.0, 1.0)]


def test_times_without_zone_ignore_daylight_saving(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        night = [datetime.datetime(2024, 3, 10, 1, 59), datetime.datetime(2024, 3, 10, 2, 30), datetime.datetime(2024, 3, 10, 3, 1)]
        df = spark.createDataFrame([(1, t) for t in night], "k int, ts timestamp_ntz")
        assert values(token_rate(df, ["k"])) == [(1, 3, 62 * 60.0, 0.0)]
        cuts = df.select("ts", grain_number(F.col("ts"), df.schema["ts"].dataType, "minute").alias("cut"))
        numbers = [row.cut for row in cuts.orderBy("ts").collect()]
        assert [n - numbers[0] for n in numbers] == [0, 31, 62]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_asof_join_against_brute_force(spark):
    random.seed(11)
    day = datetime.datetime(2024, 1, 1)

    def moment():
        return day + datetime.timedelta(minutes=random.randrange(0, 6000, 5))

    left = [(i, random.choice([1, 1, 2, 3, 9, None]), random.choice([moment(), moment(), None])) for i in range(500)]
    right = [(random.choice([1, 1, 1, 2, 3, None]), moment(), i) for i in range(200)]
    expected = []
    for i, key, at in left:
        known = [(t, v) for k, t, v in right if k is not None and k == key and at is not None and t <= at]
        expected.append((i, key, at, max(known)[1] if known else None))
    frames = (
        spark.createDataFrame(left, "id int, k int, at timestamp_ntz").repartition(5),
        spark.createDataFrame(right, "k int, t timestamp_ntz, v int").repartition(5),
    )
    for grain in ("hour", "day", "week", 1000):
        got = asof_join(*frames, "k", "at", "t", ["v"], grain)
        assert re.search(r"hashpartitioning\(_key#\d+, _cut#\d+", plan_of(got))
        assert values(got) == sorted(expected, key=repr)


def test_range_join_against_brute_force(spark):
    random.seed(12)
    day = datetime.datetime(2024, 1, 1)
    points = [(i, day + datetime.timedelta(minutes=random.randrange(0, 9000))) for i in range(300)]
    spans = []
    for i in range(40):
        start = day + datetime.timedelta(hours=random.randrange(0, 150))
        spans.append((i, start, start + datetime.timedelta(hours=random.choice([0, 1, 24, 60]))))
    expected = [(p, s) for p, at in points for s, a, b in spans if a <= at < b]
    p = spark.createDataFrame(points, "p int, at timestamp_ntz")
    s = spark.createDataFrame(spans, "s int, a timestamp_ntz, b timestamp_ntz")
    got = range_join(p, s, "at", "a", "b")
    assert values(got.select("p", "s")) == sorted(expected, key=repr)
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
    left = range_join(p, s, "at", "a", "b", how="left").select("p", "s")
    alone = {p for p, _ in points} - {p for p, _ in expected}
    assert values(left) == sorted(expected + [(p, None) for p in alone], key=repr)


def test_open_and_long_intervals(spark):
    day = lambda text: datetime.datetime.fromisoformat(text)
    points = [(i, day("2020-01-01") + datetime.timedelta(hours=7 * i)) for i in range(400)] + [(900, None), (901, day("1990-01-01"))]
    spans = [("open", "2020-01-05", "9999-12-31"), ("short", "2020-01-03", "2020-01-04"), ("months", "2020-01-31", "2020-04-30"),
             ("years", "2000-01-01", "2020-02-01"), ("empty", "2020-01-03", "2020-01-03"), ("turned", "2020-02-03", "2020-01-03")]
    left = spark.createDataFrame(points, "id int, at timestamp_ntz")
    right = spark.createDataFrame([(n, day(a), day(b)) for n, a, b in spans], "name string, opens timestamp_ntz, closes timestamp_ntz")
    expected = [(i, n) for i, at in points for n, a, b in spans if at and day(a) <= at < day(b)]
    for grain in ("minute", "day"):
        found = range_join(left, right, "at", "opens", "closes", grain=grain).select("id", "name")
        assert values(found) == sorted(expected, key=repr)
    alone = [(i, None) for i, _ in points if i not in {i for i, _ in expected}]
    found = range_join(left, right, "at", "opens", "closes", how="left").select("id", "name")
    assert values(found) == sorted(expected + alone, key=repr)
    assert range_join(left, right.limit(0), "at", "opens", "closes", how="left").count() == len(points)
    with pytest.raises(ValueError, match="columns named"):
        range_join(left, right.withColumnRenamed("name", "ID"), "at", "opens", "closes")


def test_asof_join_on_several_keys(spark):
    at = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=n)
    left = spark.createDataFrame([(1, "a", at(5)), (1, "b", at(5)), (1, None, at(5)), (2, "a", at(99))], "k int, s string, t timestamp_ntz")
    right = spark.createDataFrame([(1, "a", at(3), 10), (1, "b", at(6), 20), (2, "a", at(1), 30)], "k int, s string, t timestamp_ntz, v int")
    found = asof_join(left, right, ["k", "s"], "t", "t", ["v"]).select("k", "s", "v")
    assert values(found) == sorted([(1, "a", 10), (1, "b", None), (1, None, None), (2, "a", 30)], key=repr)
    with pytest.raises(ValueError, match="columns named"):
        asof_join(left, right.withColumnRenamed("v", "S2").withColumnRenamed("s", "x"), ["k"], "t", "t", ["t"])


def test_many_last_messages_of_a_hot_conversation(spark):
    hot = spark.range(9000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"))
    rows = hot.union(spark.range(30).select(F.lit(2).alias("conv_id"), F.col("id").alias("turn")))
    found = last_messages(rows, 2000)
    assert found.columns == ["conv_id", "turn"]
    assert found.where("conv_id = 1").agg(F.min("turn"), F.count("*")).head() == (7000, 2000)
    assert found.where("conv_id = 2").count() == 30


def test_references_by_whole_number_decimals(spark):
    child = spark.createDataFrame([(Decimal(1),), (Decimal(2),)], "ref decimal(10,0)")
    found = discover_references({"c": child, "p": spark.range(5).toDF("id")}, {"p": ["id"]})
    assert [(row.child_table, row.parent_column) for row in found.collect()] == [("c", "id")]


def test_snapshot_failures_and_removal(spark, tmp_path):
    root = str(tmp_path)
    write_snapshot(spark.range(150), root, "kept")
    broken = spark.range(4).select(F.raise_error(F.lit("no")).cast("int").alias("x"))
    with pytest.raises(Exception):
        write_snapshot(broken, root, "kept")
    assert read_snapshot(spark, root, "kept").count() == 150
    assert [path.name for path in (tmp_path / "kept").iterdir()] == ["source.parquet"]
    assert delete_snapshot(spark, root, "kept") and not delete_snapshot(spark, root, "kept")
    assert list_snapshots(spark, root).count() == 0


def test_braces_that_name_no_frame(spark):
    text = """SELECT id, GET_JSON_OBJECT('{"a": {"b": 1}}', '$.a.b') AS b FROM {rows} WHERE id < 2"""
    assert values(sql(spark, text, rows=spark.range(5))) == [(0, "1"), (1, "1")]
