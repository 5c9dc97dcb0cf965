"""Filled days, trends and values of other years against brute force."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest

from curbside.operators import fill_days, with_trend, years_before
from tests.conftest import rows_of

DAY = dt.date(2015, 12, 20)


def series(seed):
    """Group 1 holds most rows and days; one group is null, and some days are."""
    draw = random.Random(seed)
    cells = {}
    for _ in range(160):
        group = draw.choice([1, 1, 1, 2, None])
        day = draw.choice([DAY + dt.timedelta(days=draw.randrange(200)), None])
        cells[group, day] = draw.choice([1, 3, 10**9])
    return [(g, d, n) for (g, d), n in cells.items()]


@pytest.mark.parametrize("half", [0, 3, 400])
@pytest.mark.parametrize("seed", [1, 2])
def test_trends_equal_brute_force(spark, seed, half):
    rows = series(seed)
    df = spark.createDataFrame(rows, "g int, day date, n bigint")
    found = with_trend(fill_days(df, ["g"], "day", "n"), ["g"], "day", "n", half)
    groups = defaultdict(dict)
    for g, day, n in rows:
        if day is not None:
            groups[g][day] = n
    expected = []
    for g, of in groups.items():
        first, last = min(of), max(of)
        days = [first + dt.timedelta(days=i) for i in range((last - first).days + 1)]
        for day in days:
            near = [of.get(d, 0) for d in days if abs((d - day).days) <= half]
            expected.append((g, day, of.get(day, 0), 1000 * sum(near) // len(near)))
    got = rows_of(found, "g", "day", "n", "trend")
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_the_year_before_is_not_the_row_before(spark):
    rows = [(1, 2012, 5), (1, 2013, 6), (1, 2015, 7), (None, 2013, 8), (None, 2014, None)]
    df = spark.createDataFrame(rows, "g int, fy int, v bigint")
    found = df.withColumn("before", years_before("v", ["g"], "fy"))
    assert set(rows_of(found, "g", "fy", "before")) == {
        (1, 2012, None), (1, 2013, 5), (1, 2015, None), (None, 2013, None), (None, 2014, 8)
    }


def test_no_days_have_no_trend(spark):
    df = spark.createDataFrame([(1, None, 4)], "g int, day date, n bigint")
    assert rows_of(with_trend(fill_days(df, ["g"], "day", "n"), ["g"], "day", "n", 3)) == []
