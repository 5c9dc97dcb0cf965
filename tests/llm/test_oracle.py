"""The queries that SQL can express give the rows of their SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from curbside.llm import ORACLE_SQL
from tests.conftest import DATA
from tests.test_oracle import assert_same


@pytest.mark.parametrize("name", list(ORACLE_SQL))
@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_sql(spark, duck, name, scale):
    df = entry_points.queries()[name](spark, f"{DATA}/{scale}")
    assert_same(df, duck(scale), entry_points.oracle_sql()[name])
