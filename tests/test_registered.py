"""Every registered query against its SQL text, at the smallest scale."""

import pytest
from checker import compare, connect
from conftest import plan_of

import __spark_entry__ as contract

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, small, duck, name):
    result = QUERIES[name](spark, small).toArrow()
    assert result.num_rows > 0
    if name in ORACLES:
        assert compare(result, duck.sql(ORACLES[name]).to_arrow_table()) == []


def test_every_text_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) > 10 and rows[0].asDict().keys() == {"n_name", "orders", "revenue"}


def test_filters_and_columns_reach_the_files(spark, small):
    plan = plan_of(QUERIES["d2_filter"](spark, small))
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(o_orderdate" in plan
    schema = plan.split("ReadSchema: ")[1]
    assert "o_custkey" not in schema
    plan = plan_of(QUERIES["d10_group_by"](spark, small))
    assert "l_orderkey" not in plan.split("ReadSchema: ")[1]


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith("d") and n != "d6_cross_join"])
def test_no_cartesian_product(spark, small, name):
    assert "CartesianProduct" not in plan_of(QUERIES[name](spark, small))


def test_no_key_carries_a_sketch(spark, small):
    """A sketch beside an exact count in one aggregation would be held once for every different key."""
    for line in plan_of(QUERIES["d11_approximate_distinct"](spark, small)).splitlines():
        assert not ("approx_count_distinct" in line and "l_orderkey" in line.partition("keys=[")[2].partition("]")[0]), line
