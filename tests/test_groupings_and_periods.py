"""Grouping sets against plain groupings; period joins against brute force."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from curbside.operators import interval_join, marginals, summed_over
from tests.conftest import rows_of


def test_each_set_equals_its_own_grouping(spark):
    rows = [(i % 3, None if i % 4 == 0 else "x", i % 7 if i % 3 else 0) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b string, c int")
    columns, sets = ["a", "b", "c"], [[], ["a"], ["b"], ["a", "c"], ["a", "b", "c"]]
    found = marginals(df, columns, sets).collect()
    for of in sets:
        mask = sum(1 << (len(columns) - 1 - columns.index(c)) for c in columns if c not in of)
        own = {tuple(r[c] for c in of): r.ticket_count for r in found if r.grouping == mask}
        plain = df.groupBy(*of).count().collect()
        assert own == {tuple(r[c] for c in of): r["count"] for r in plain}
    assert len(found) == sum(df.select(*of).distinct().count() if of else 1 for of in sets)


def test_a_null_value_is_no_subtotal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "x")], "a int, b string")
    found = marginals(df, ["a", "b"], [["a"], ["a", "b"]])
    flagged = found.withColumn("total", summed_over(F.col("grouping"), ["a", "b"], "b"))
    assert sorted(rows_of(flagged, "total", "b", "ticket_count"), key=repr) == sorted(
        [(False, None, 2), (False, "x", 1), (True, None, 3)], key=repr
    )


def test_no_rows_have_no_groups(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert rows_of(marginals(df, ["a", "b"], [["a"], ["a", "b"]])) == []


DAY = dt.date(2015, 1, 1)


def tables(spark, seed):
    draw = random.Random(seed)

    def day(most=900):
        return DAY + dt.timedelta(days=draw.randrange(-most, most))

    # Half the rows on one key and date; nulls in every column.
    rows = [(i, 1, DAY) for i in range(60)]
    rows += [(100 + i, draw.choice([1, 2, 3, None]), draw.choice([day(), None])) for i in range(60)]
    periods = []
    for i in range(40):
        begins = draw.choice([day(), day(), None])
        ends = draw.choice([None, begins and begins + dt.timedelta(days=draw.randrange(-5, 400))])
        periods.append((draw.choice([1, 2, None]), begins, ends, i))
    return (
        spark.createDataFrame(rows, "id int, k int, at date"),
        spark.createDataFrame(periods, "k int, begins date, ends date, price int"),
        rows, periods,
    )


@pytest.mark.parametrize("days", [1, 30, 5000])
@pytest.mark.parametrize("seed", [1, 2])
def test_periods_equal_brute_force(spark, seed, days):
    left, right, rows, periods = tables(spark, seed)
    expected = [
        (i, price) for i, k, at in rows for kk, begins, ends, price in periods
        if k is not None and k == kk and at and begins and begins <= at
        and (ends is None or at <= ends)
    ]
    span = (str(DAY - dt.timedelta(days=900)), str(DAY + dt.timedelta(days=900)))
    found = interval_join(left, right, ["k"], "at", "begins", "ends", days, span)
    assert sorted(rows_of(found, "id", "price")) == sorted(expected)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_open_periods_without_a_span_hold_all_later_rows(spark):
    late = DAY + dt.timedelta(days=4000)
    rows = spark.createDataFrame([(1, 1, DAY), (2, 1, late)], "id int, k int, at date")
    periods = spark.createDataFrame(
        [(1, DAY - dt.timedelta(days=10), None, 5), (1, DAY, DAY + dt.timedelta(days=9), 6)],
        "k int, begins date, ends date, price int",
    )
    found = interval_join(rows, periods, ["k"], "at", "begins", "ends")
    assert sorted(rows_of(found, "id", "price")) == [(1, 5), (1, 6), (2, 5)]
    assert rows_of(interval_join(rows.limit(0), periods, ["k"], "at", "begins", "ends")) == []


def test_left_keeps_rows_without_a_period(spark):
    left, right, rows, _ = tables(spark, 3)
    found = interval_join(left, right, ["k"], "at", "begins", "ends", 64, how="left")
    assert {r.id for r in found.collect()} == {r[0] for r in rows}
