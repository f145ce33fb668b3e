"""Profiles of document collections, and files that become tables in one step."""

import pytest
from conftest import values

from tabletop.operators import load_file, profile_collections
from tabletop.plans.transfer import new_database
from tabletop.sources.documents import document_column


def documents(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "j string").select(document_column("j").alias("doc"))


def test_profile_collections(spark):
    numbered = documents(spark, ['{"_id": 9, "a": 1}', '{"_id": 10, "a": "x", "b": [1]}'])
    named = documents(spark, ['{"_id": "k2"}', '{"_id": 7}', '{"_id": "k1"}'])
    bare = documents(spark, ['{"a": null}'])
    empty = documents(spark, [])
    found = {r["table"]: r for r in profile_collections({"n": numbered, "s": named, "b": bare, "e": empty}).collect()}
    assert found["n"].row_count == 2 and (found["n"].first_pk, found["n"].last_pk) == ("9", "10")
    assert found["n"].column_types == {"_id": "int", "a": "int,str", "b": "list"} and found["n"].primary_keys == ["_id"]
    assert (found["s"].first_pk, found["s"].last_pk, found["s"].candidate_keys) == ("7", "k2", ["_id"])
    assert (found["b"].first_pk, found["b"].primary_keys, found["b"].columns) == (None, [], ["a"])
    assert (found["e"].row_count, found["e"].columns, found["e"].unique_keys) == (0, [], [])


def test_load_file(spark, tmp_path):
    name = f"{new_database(spark)}.people"
    (tmp_path / "a.csv").write_text("id,zip code\n1,007\n2,\n")
    (tmp_path / "b.tsv").write_text("id\tzip code\n3\t12\n")
    (tmp_path / "c.json").write_text('[{"id": 4, "zip code": "x"}]')
    for file in ("a.csv", "b.tsv", "c.json"):
        load_file(spark, str(tmp_path / file), name)
    assert values(spark.table(name)) == [(1, "007"), (2, None), (3, "12"), (4, "x")]
    assert spark.table(name).schema.simpleString() == "struct<id:bigint,zip_code:string>"
    (tmp_path / "d.csv").write_text("id,zip code\nfive,1\n")
    with pytest.raises(Exception, match="cannot hold"):
        load_file(spark, str(tmp_path / "d.csv"), name)
    with pytest.raises(ValueError, match="no reader"):
        load_file(spark, str(tmp_path / "e.xyz"), name)
    assert spark.table(name).count() == 4
