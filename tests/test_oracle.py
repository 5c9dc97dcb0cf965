"""Every query gives the rows its SQL gives, on both kinds of stages."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from curbside import REGISTRY, TicketStages, tickets_from_order_tables
from tests.conftest import DATA

SQL_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def connections(duck):
    return {scale: duck(scale) for scale in ("sf0.001", "sf0.01")}


def assert_same(df, connection, sql):
    result = connection.execute(sql)
    types = {c[0]: str(c[1]) for c in result.description}
    assert {c: SQL_TYPES[t] for c, t in df.dtypes} == types
    position = [list(types).index(c) for c in df.columns]
    expected = [tuple(row[i] for i in position) for row in result.fetchall()]
    got = [tuple(row) for row in df.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert got


@pytest.mark.parametrize("name", list(REGISTRY))
def test_shared_table(spark, connections, name):
    df = entry_points.queries()[name](spark, f"{DATA}/sf0.01")
    assert_same(df, connections["sf0.01"], entry_points.oracle_sql()[name])


@pytest.fixture(scope="module")
def computed(spark):
    return TicketStages(tickets_from_order_tables(spark, f"{DATA}/sf0.001"))


@pytest.mark.parametrize("name", list(REGISTRY))
def test_computed_from_source(computed, connections, name):
    df = REGISTRY[name].build(computed)
    assert_same(df, connections["sf0.001"], REGISTRY[name].sql)


def test_entry_gives_five_codes_a_year(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["file_fy", "violation_code", "ticket_count", "rank"]
    per_year = {r.file_fy: r["count"] for r in df.groupBy("file_fy").count().collect()}
    assert per_year == {year: 5 for year in range(1995, 2003)}


def test_all_queries_have_sql():
    assert len(REGISTRY) >= 48
    assert REGISTRY.keys() <= entry_points.queries().keys()
    assert REGISTRY.keys() <= entry_points.oracle_sql().keys()
    assert entry_points.oracle_sql().keys() <= entry_points.queries().keys()
