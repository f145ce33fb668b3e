import datetime
from pathlib import Path

import pytest
from conftest import values
from pyspark.sql import functions as F

from tabletop.operators.load import load_into
from tabletop.operators.state import add_state, column_state, described, read_state
from tabletop.plans import registry
from tabletop.plans.transfer import new_database
from tabletop.session import shared_folder, working_folder
from tabletop.streaming import ingest_incremental
from tabletop.streaming.ingest import append_batch


def test_each_file_once(spark, tmp_path):
    inbox, notes = tmp_path / "in box", str(tmp_path / "notes")
    inbox.mkdir()
    name = f"{new_database(spark)}.t"
    spark.sql(f"CREATE TABLE {name} (id BIGINT, label STRING) USING parquet")
    load_into(name, spark.createDataFrame([(0, "older")], "a int, b string"))
    (inbox / "a.csv").write_text('key,text\n1,"x, y"\n2,\n')
    assert values(ingest_incremental(spark, str(inbox), name, notes)) == [(0, "older"), (1, "x, y"), (2, None)]
    (inbox / "b.csv").write_text("key,text\n3,z\n")
    assert ingest_incremental(spark, str(inbox), name, notes).count() == 4
    assert ingest_incremental(spark, str(inbox), name, notes).count() == 4
    (inbox / "c.csv").write_text("key,text\nbad,z\n")
    with pytest.raises(Exception):
        ingest_incremental(spark, str(inbox), name, notes)
    (inbox / "c.csv").write_text('key,text\n4,"z\nz"\n')
    (inbox / "d.csv").write_text("key,text\n5,5\" pipe\n")
    assert sorted(row.id for row in ingest_incremental(spark, str(inbox), name, notes).collect()) == [0, 1, 2, 3, 4, 5]


def test_json_by_name(spark, tmp_path):
    inbox, notes = tmp_path / "inbox", str(tmp_path / "notes")
    inbox.mkdir()
    name = f"{new_database(spark)}.t"
    spark.sql(f"CREATE TABLE {name} (id BIGINT, the_label STRING, parts ARRAY<INT>, day DATE) USING parquet")
    (inbox / "a.json").write_text('{" the label ": "x", "id": 7, "parts": [1, 2]}\n\n{"id": 8, "day": "2024-02-29"}\n')
    got = ingest_incremental(spark, str(inbox), name, notes, file_format="json")
    assert values(got) == [(7, "x", [1, 2], None), (8, None, None, datetime.date(2024, 2, 29))]
    (inbox / "upper.json").write_text('{"ID": 9, "The Label": "u"}\n')
    assert ingest_incremental(spark, str(inbox), name, notes, file_format="json").where("id = 9 and the_label = 'u'").count() == 1
    for bad in ('{"id": 1, "unknown": 2}\n', '{"id": "seven"}\n', '{"id": 1\n', '{"id": 1, " id": 2}\n'):
        (inbox / "b.json").write_text(bad)
        with pytest.raises(Exception):
            ingest_incremental(spark, str(inbox), name, notes, file_format="json")
        assert spark.table(name).count() == 3


def test_working_folders_are_shared_and_new(spark):
    first, second = working_folder(spark, "x"), working_folder(spark, "x")
    assert first != second and first.startswith(shared_folder(spark))


def test_repeated_batch_changes_nothing(spark, tmp_path):
    inbox, notes = tmp_path / "inbox", str(tmp_path / "notes")
    inbox.mkdir()
    name = f"{new_database(spark)}.t"
    spark.sql(f"CREATE TABLE {name} (id BIGINT, label STRING, batch BIGINT) USING parquet PARTITIONED BY (batch)")
    for i, text in enumerate(("1,a\n2,b\n", "3,c\n")):
        (inbox / f"{i}.csv").write_text("id,label\n" + text)
        ingest_incremental(spark, str(inbox), name, notes, batch_column="batch")
    expected = [(1, "a", 0), (2, "b", 0), (3, "c", 1)]
    assert values(spark.table(name)) == expected
    append_batch(name, spark.createDataFrame([(3, "c")], "id bigint, label string"), 1, "batch")
    assert values(spark.table(name)) == expected


def test_json_layouts(spark, tmp_path):
    inbox, notes = tmp_path / "inbox", str(tmp_path / "notes")
    inbox.mkdir()
    name = f"{new_database(spark)}.t"
    spark.sql(f"CREATE TABLE {name} (id BIGINT, label STRING, parts ARRAY<INT>) USING parquet")
    (inbox / "a.json").write_text('[{"id": 1, "label": "x"},\n {"Label": null, "id": 2, "parts": [3]}]')
    (inbox / "b.json").write_text('{\n "id": 3,\n "label": "one\\nobject"}')
    (inbox / "c.json").write_text('{\n"id": [4, 5],\n"label": ["p", "q"], "parts": [[1, 2], null]}')
    (inbox / "d.json").write_text('{"id": 6}\n{"id": 7}\n')
    (inbox / "e.json").write_text("[]")
    got = ingest_incremental(spark, str(inbox), name, notes, file_format="json")
    assert values(got) == [(1, "x", None), (2, None, [3]), (3, "one\nobject", None), (4, "p", [1, 2]), (5, "q", None), (6, None, None), (7, None, None)]
    (inbox / "f.json").write_text('[{"id": 8, "unknown": 1}]')
    with pytest.raises(Exception):
        ingest_incremental(spark, str(inbox), name, notes, file_format="json")


def facts(state, schema):
    rows = described(state, schema).collect()
    return [row[:4] + row[5:7] for row in map(tuple, rows)], {row.column: (row.distinct, row.quantiles) for row in rows}


def test_profile_grows_with_each_file(spark, tmp_path):
    inbox, notes, state = tmp_path / "inbox", str(tmp_path / "notes"), str(tmp_path / "state")
    inbox.mkdir()
    name = f"{new_database(spark)}.t"
    spark.sql(f"CREATE TABLE {name} (id BIGINT, price DECIMAL(20,2), day DATE, label STRING) USING parquet")
    load_into(name, spark.range(3000).select("id", (F.col("id") % 7).cast("decimal(20,2)"), F.lit(datetime.date(2024, 1, 1)), F.lit("a")))
    schema = spark.table(name).schema
    for i in range(3):
        lines = [f"{j},{j % 50 + 0.25},2024-02-{i + 1:02},{'b' if j % 3 else ''}" for j in range(2000 * i, 2000 * i + 2500)]
        (inbox / f"{i}.csv").write_text("\n".join(["id,price,day,label", *lines]))
        ingest_incremental(spark, str(inbox), name, notes, profile=state)
        exact, estimates = facts(read_state(spark, state), schema)
        scratch, others = facts(column_state(spark.table(name)), schema)
        assert exact == scratch and exact[0][2] == 3000 + 2500 * (i + 1) and exact[3][3] > 0
        for column, (distinct, quantiles) in estimates.items():
            real = spark.table(name).select(column).distinct().where(f"{column} IS NOT NULL").count()
            assert abs(distinct - real) <= 0.04 * real and abs(others[column][0] - real) <= 0.04 * real
            if column == "id":
                ids = sorted(row.id for row in spark.table(name).select("id").collect())
                assert all(abs(value - ids[int(len(ids) * q)]) < 300 for value, q in zip(quantiles, (0.25, 0.5, 0.75)))
    assert ingest_incremental(spark, str(inbox), name, notes, profile=state).count() == 10500
    assert facts(read_state(spark, state), schema)[0] == exact
    # A batch that is repeated leaves its state once, and only states are read.
    add_state(spark.table(name).where("day = '2024-02-03'"), state, 2)
    assert facts(read_state(spark, state), schema)[0] == exact
    assert all(state in name for name in read_state(spark, state).inputFiles())


def test_state_of_nothing_and_of_nested_columns(spark, tmp_path):
    df = spark.createDataFrame([], "id int, list array<int>, pairs map<string,int>, flag boolean")
    add_state(df, str(tmp_path / "state"), -1)
    rows = described(read_state(spark, str(tmp_path / "state")), df.schema).collect()
    assert [(r.row_count, r.null_count, r.distinct, r.low, r.quantiles) for r in rows] == [(0, 0, 0, None, None)] * 4
    some = spark.createDataFrame([(1, [1], {"a": 1}, True), (None, [2], None, None)], df.schema)
    row = {r.column: r for r in described(column_state(some), df.schema).collect()}
    assert row["list"].distinct == 2 and row["pairs"].null_count == 1 and row["flag"].high == "true" and row["id"].quantiles == [1.0] * 3


def test_arrays_of_ten_thousand_ids(spark, tmp_path):
    """Files cost more than rows: ids that go far make few of them, all in one folder."""
    spark.range(30_000).selectExpr(
        "id AS event_id", "TIMESTAMP_NTZ '2000-01-01' AS ts", "id % 5 AS user_id", "'click' AS event_type", "0.5D AS value",
        "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    before = set(Path(shared_folder(spark).removeprefix("file:")).glob("tabletop/inbox-*-arrays"))
    found = registry.queries()["s13_ingest_json_layouts"](spark, str(tmp_path))
    assert found.count() == 30_000 and found.select("event_id").distinct().count() == 30_000
    inbox, = set(Path(shared_folder(spark).removeprefix("file:")).glob("tabletop/inbox-*-arrays")) - before
    assert len(list(inbox.glob("*.txt"))) == 3
