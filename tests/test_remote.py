"""Remote sources without a database: what is asked of Spark's JDBC reader, and what is made of catalog rows."""

import pytest
from conftest import values

from tabletop.operators import profile
from tabletop.sources import jdbc

OPTIONS = {"url": "jdbc:postgresql://host/db", "user": "u", "fetchsize": "1000"}


class Recorder:
    """Stands in for ``spark.read``: notes what it is told."""

    def __init__(self):
        self.told = {}

    def format(self, name):
        self.told["format"] = name
        return self

    def options(self, **options):
        self.told.update(options)
        return self

    def option(self, key, value):
        self.told[key] = value
        return self

    def load(self):
        return self.told

    def jdbc(self, url, table, predicates, properties):
        return {"url": url, "table": table, "predicates": predicates, **properties}


class Session:
    def __init__(self, spark):
        self.sparkContext = spark.sparkContext

    @property
    def read(self):
        return Recorder()


def asked(monkeypatch, answer):
    texts = []

    def read_query(spark, options, sql):
        texts.append(sql)
        return answer(sql)

    monkeypatch.setattr(jdbc, "read_query", read_query)
    return texts


def test_query_text(spark):
    told = jdbc.read_query(Session(spark), OPTIONS, "SELECT 1; ")
    assert told["query"] == "SELECT 1" and told["format"] == "jdbc" and told["fetchsize"] == "1000"


def test_whole_table(spark):
    assert jdbc.read_table(Session(spark), OPTIONS, "t")["dbtable"] == '"public"."t"'
    assert jdbc.read_table(Session(spark), OPTIONS, "t", schema="s")["dbtable"] == '"s"."t"'


def test_numeric_strides(spark, monkeypatch):
    asked(monkeypatch, lambda sql: spark.sql("SELECT 5L AS low, 99L AS high, 7L AS total"))
    told = jdbc.read_table(Session(spark), OPTIONS, "t", "id", 8)
    assert (told["partitionColumn"], told["lowerBound"], told["upperBound"], told["numPartitions"]) == ("id", 5, 100, 8)
    asked(monkeypatch, lambda sql: spark.sql("SELECT CAST(NULL AS BIGINT) AS low, CAST(NULL AS BIGINT) AS high, 0L AS total"))
    assert "partitionColumn" not in jdbc.read_table(Session(spark), OPTIONS, "t", "id", 8)


def test_ranges_of_texts_and_balanced_numbers(spark, monkeypatch):
    def texts(sql):
        if "NTILE" in sql:
            return spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'f'), (3, 'q') AS r(part, first_key)")
        return spark.sql("SELECT 'a' AS low, 'z' AS high, 9L AS total")

    said = asked(monkeypatch, texts)
    told = jdbc.read_table(Session(spark), OPTIONS, "t", "code", 3)
    assert told["predicates"] == ['"code" < \'f\' OR "code" IS NULL', '"code" >= \'f\' AND "code" < \'q\'', '"code" >= \'q\'']
    assert told["table"] == '"public"."t"' and told["user"] == "u" and "NTILE(3)" in said[1]

    def numbers(sql):
        if "NTILE" in sql:
            return spark.sql("SELECT * FROM VALUES (1, 1L), (2, 1000000L) AS r(part, first_key)")
        return spark.sql("SELECT 1L AS low, 2000000L AS high, 9L AS total")

    asked(monkeypatch, numbers)
    told = jdbc.read_table(Session(spark), OPTIONS, "t", "id", 2, balanced=True)
    assert told["predicates"] == ['"id" < 1000000 OR "id" IS NULL', '"id" >= 1000000']


def test_attached_catalog_settings(spark):
    jdbc.attach(spark, "away", OPTIONS)
    assert spark.conf.get("spark.sql.catalog.away").endswith("JDBCTableCatalog")
    assert spark.conf.get("spark.sql.catalog.away.url") == OPTIONS["url"]
    assert spark.conf.get("spark.sql.catalog.away.pushDownAggregate") == "true"


def test_documents_need_their_connector(spark):
    from tabletop.sources.documents import read_documents

    with pytest.raises(Exception, match="(?i)mongodb"):
        read_documents(spark, options={"connection.uri": "x"})


@pytest.mark.parametrize("name", ["postgresql", "mysql", "sqlserver"])
def test_remote_profile(spark, monkeypatch, name):
    options = {"url": f"jdbc:{name}://host/db"}
    tables = {
        "head": spark.createDataFrame([(1, "a"), (12, "b")], "id int, code string"),
        "log": spark.createDataFrame([("x",)], "line string"),
    }

    def read_query(spark, options, sql):
        if "constraint_name" in sql:
            rows = [("head", "pk", "P", 1, "id", None, None), ("head", "u", "U", 1, "code", None, None)]
            return spark.createDataFrame(rows, profile.KEY_COLUMN_SCHEMA)
        if "size_bytes" in sql:
            return spark.createDataFrame([("head", 2048), ("log", 0)], "table_name string, size_bytes bigint")
        if "MIN(" in sql:
            return tables["head"].selectExpr("min(id) AS low", "max(id) AS high", "count(*) AS total")
        assert "log" in sql
        return tables["log"].selectExpr("count(*) AS total")

    monkeypatch.setattr(profile, "read_query", read_query)
    monkeypatch.setattr(profile, "read_table", lambda spark, options, table, schema: tables[table])
    got = profile.profile_remote(spark, options, "it's")
    rows = got.select("table", "row_count", "size_pretty", "first_pk", "last_pk", "primary_keys", "candidate_keys")
    assert values(rows) == [
        ("head", 2, "2.0 KB", "1", "12", ["id"], ["code", "id"]),
        ("log", 1, "0 B", None, None, [], []),
    ]


def test_vendor_without_catalog_query(spark):
    with pytest.raises(ValueError, match="oracle"):
        profile.declared_keys(spark, {"url": "jdbc:oracle:thin:@h"}, "s")
