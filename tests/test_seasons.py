"""Months and seasons within a fiscal year."""

from __future__ import annotations

import datetime as dt

import pytest

from curbside.plans.examine import total_tickets
from curbside.plans.seasons import distinct_months, season_bins, season_frequency
from curbside.plans.seasons import top3_codes_by_season
from curbside.shared import stages_for
from tests.conftest import DATA, rows_of

# Values printed with the published results, then the edges of the seasons.
SEASONS = [
    ("09/08/2014", "Fall"),
    ("04/15/2015", "Spring"),
    ("09/30/2014", "Fall"),
    ("06/14/2015", "Summer"),
    ("11/23/2014", "Fall"),
    ("10/19/2014", "Fall"),
    ("12/01/2014", "Winter"),
    ("02/28/2015", "Winter"),
    ("03/01/2015", "Spring"),
    ("05/31/2015", "Spring"),
    ("08/15/2014", "Summer"),
    ("06/15/2015", "Summer"),
    ("11/30/2014", "Fall"),
]


@pytest.mark.parametrize("text, season", SEASONS)
def test_season(make_stages, text, season):
    date = dt.datetime.strptime(text, "%m/%d/%Y").date()
    stages = make_stages({"issue_date": text})
    assert rows_of(season_bins(stages), "issue_dt", "issue_month", "season") == [
        (date, date.month, season)
    ]


def test_both_ends_of_a_fiscal_year_are_one_summer(make_stages):
    stages = make_stages(
        {"issue_date": "08/15/2014"}, {"issue_date": "06/15/2015"}, {"issue_date": "01/05/2015"}
    )
    assert rows_of(season_frequency(stages)) == [(2015, "Summer", 2), (2015, "Winter", 1)]
    assert sorted(rows_of(distinct_months(stages))) == [(2015, 1), (2015, 6), (2015, 8)]


def test_codes_of_each_season(make_stages):
    codes = [21, 21, 38, 14, 5]
    stages = make_stages(
        *[{"issue_date": "10/01/2014", "violation_code": c} for c in codes],
        {"issue_date": "01/05/2015", "violation_code": 99},
    )
    assert rows_of(top3_codes_by_season(stages), "season", "violation_code", "rank") == [
        ("Fall", 21, 1), ("Fall", 5, 2), ("Fall", 14, 3), ("Winter", 99, 1),
    ]


def test_seasons_add_up_to_all_tickets(spark):
    stages = stages_for(spark, f"{DATA}/sf0.01")
    by_year = season_frequency(stages).groupBy("file_fy").sum("ticket_count")
    assert dict(rows_of(by_year)) == dict(rows_of(total_tickets(stages)))
