"""Violation times, good and bad."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from curbside.functions.clock import with_parts
from curbside.plans import clock_times as ct
from tests.conftest import rows_of


def times(make_tickets, *texts):
    return make_tickets(*[{"violation_time": t} for t in texts])


@pytest.mark.parametrize(
    "text, hour, meridiem",
    [
        ("0953A", 9, "A"),
        ("0520P", 5, "P"),
        ("2553A", 25, "A"),
        ("-153A", -1, "A"),
        ("A953A", None, "A"),
        ("0953", 9, None),
        ("09530", 9, "0"),
        ("0953AM", 9, "AM"),
        ("", None, None),
        (None, None, None),
    ],
)
def test_parts(make_tickets, text, hour, meridiem):
    parts = with_parts(times(make_tickets, text))
    assert rows_of(parts, "hour", "am_pm") == [(hour, meridiem)]


def test_missing_times_are_those_without_a_part(make_stages):
    texts = [None, "", "A953A", "0953", "2553A", "09530", "0953AM", "0953A"]
    stages = make_stages(*[{"violation_time": t} for t in texts])
    assert rows_of(ct.missing_time_count(stages)) == [(2015, 4)]
    assert rows_of(ct.missing_time_share(stages)) == [(2015, 4, 8, 0.5)]
    hours = rows_of(ct.hour_distribution(stages), "hour", "ticket_count")
    assert hours == [(9, 3), (25, 1)]
    assert rows_of(ct.meridiem_distribution(stages), "am_pm", "ticket_count") == [
        ("A", 2), ("0", 1), ("AM", 1),
    ]
    assert rows_of(ct.valid_violation_time(stages), "clock_time") == [("9:A",)]


@pytest.mark.parametrize(
    "text, label, time_bin",
    [
        # Values printed with the published results.
        ("0953A", "9:A", "Day"),
        ("0520P", "5:P", "Dusk"),
        ("0545P", "5:P", "Dusk"),
        ("0443A", "4:A", "Dawn"),
        ("0327A", "3:A", "MidNight"),
        ("0237A", "2:A", "MidNight"),
        # Twelve is zero.
        ("1215A", "0:A", "MidNight"),
        ("0015A", "0:A", "MidNight"),
        ("1215P", "0:P", "Noon"),
        ("0015P", "0:P", "Noon"),
        # Edges of the bins.
        ("0359A", "3:A", "MidNight"),
        ("0400A", "4:A", "Dawn"),
        ("0759P", "7:P", "Dusk"),
        ("0800P", "8:P", "Night"),
        ("1159P", "11:P", "Night"),
        # No lower bound on the hour, but no bin for it either.
        ("-153A", "-1:A", None),
    ],
)
def test_labels_and_bins(make_tickets, text, label, time_bin):
    timed = ct.binned(with_parts(times(make_tickets, text)))
    assert rows_of(timed, "clock_time", "time_bin") == [(label, time_bin)]


def test_twelve_and_zero_are_two_labels_before_folding(make_stages):
    stages = make_stages({"violation_time": "1215A"}, {"violation_time": "0015A"})
    counted = rows_of(ct.clock_time_distribution(stages), "clock_time", "ticket_count")
    assert sorted(counted) == [("0:A", 1), ("12:A", 1)]
    assert rows_of(ct.normalized_violation_time(stages), "hour", "clock_time") == [
        (0, "0:A"), (0, "0:A"),
    ]


def test_binless_times_count_for_codes_but_form_no_bin(make_stages):
    stages = make_stages(
        *[{"violation_time": "-153A", "violation_code": 5}] * 3,
        *[{"violation_time": "0953A", "violation_code": 7}] * 2,
    )
    codes = rows_of(ct.top3_codes_timed(stages), "violation_code", "ticket_count")
    assert codes == [(5, 3), (7, 2)]
    assert rows_of(ct.top3_codes_by_time_bin(stages), "time_bin", "violation_code") == [
        ("Day", 7)
    ]
    bins = rows_of(ct.top3_bins_by_top_code(stages), "violation_code", "time_bin")
    assert bins == [(5, None), (7, "Day")]


def test_bins_of_top_codes(make_stages):
    def tickets(code, text, count):
        return [{"violation_code": code, "violation_time": text}] * count

    stages = make_stages(
        *tickets(1, "0900A", 5), *tickets(1, "0100P", 3), *tickets(1, "0500A", 3),
        *tickets(1, "0900P", 1),
        *tickets(2, "0500P", 4), *tickets(3, "0900A", 2), *tickets(4, "0900A", 1),
        *tickets(None, "0900A", 1),
    )
    got = rows_of(ct.top3_bins_by_top_code(stages))
    assert got == [
        (2015, 1, 1, 1, "Day", 5),
        (2015, 1, 1, 2, "Dawn", 3),
        (2015, 1, 1, 3, "Noon", 3),
        (2015, 2, 2, 1, "Dusk", 4),
        (2015, 3, 3, 1, "Day", 2),
    ]


def test_bins_add_up_to_timed_tickets(spark):
    from curbside.shared import stages_for
    from tests.conftest import DATA

    stages = stages_for(spark, f"{DATA}/sf0.01")
    per_bin = ct.time_bins(stages).groupBy("file_fy", "time_bin").count()
    by_year = dict(rows_of(per_bin.groupBy("file_fy").agg(F.sum("count"))))
    valid = dict(rows_of(ct.valid_violation_time(stages).groupBy("file_fy").count()))
    assert by_year == valid
    assert {r.time_bin for r in per_bin.collect()} == {
        "MidNight", "Dawn", "Day", "Noon", "Dusk", "Night",
    }
