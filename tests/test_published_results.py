"""Later steps on tables published for the full ticket files.

The files are not at hand, so the printed output of one step is the input here
and the printed output of the next is what must come out.
"""

from __future__ import annotations

from curbside.functions.fines import FINES, fine_schedule
from curbside.plans.fines import top3_code_occurrences, top_revenue_code, with_revenue
from curbside.plans.precincts import codes_in_all, common_codes_across_precincts
from curbside.plans.precincts import code_concentration, tickets_in_top_precincts
from curbside.plans.precincts import top10_codes_by_precinct
from tests.conftest import rows_of

# Fiscal year, issuer precinct, its ten most frequent codes.
TOP_CODES = [
    (2015, 0, [36, 7, 21, 5, 66, 14, 17, 20, 46, 78]),
    (2015, 19, [38, 37, 14, 16, 21, 46, 20, 40, 71, 19]),
    (2015, 18, [14, 69, 31, 47, 42, 38, 46, 84, 19, 37]),
    (2016, 0, [36, 7, 21, 5, 66, 14, 85, 17, 20, 78]),
    (2016, 19, [38, 37, 46, 14, 21, 16, 20, 40, 71, 19]),
    (2016, 18, [14, 69, 47, 31, 42, 46, 38, 84, 19, 37]),
    (2017, 0, [36, 7, 21, 5, 66, 14, 78, 20, 17, 40]),
    (2017, 19, [46, 38, 37, 14, 21, 16, 20, 40, 71, 19]),
    (2017, 14, [14, 69, 31, 47, 42, 46, 84, 19, 82, 17]),
]

# Fiscal year, code, occurrences, fines collected.
REVENUE = [
    (2015, 14, 908418, 104468070),
    (2015, 21, 1469228, 80807540),
    (2015, 38, 1305007, 65250350),
    (2016, 21, 1497269, 82349795),
    (2016, 36, 1232952, 61647600),
    (2016, 38, 1126835, 56341750),
    (2017, 21, 1500396, 82521780),
    (2017, 36, 1345237, 67261850),
    (2017, 38, 1050418, 52520900),
]


def test_common_codes(spark):
    lists = spark.createDataFrame(
        [(year, precinct, code) for year, precinct, codes in TOP_CODES for code in codes],
        "file_fy int, issuer_precinct int, violation_code int",
    )
    assert sorted(rows_of(codes_in_all(lists))) == [
        (2015, 14), (2015, 46), (2016, 14), (2017, 14),
    ]


def test_revenue(spark):
    occurrences = spark.createDataFrame(
        [row[:3] for row in REVENUE], "file_fy int, violation_code int, occurrences bigint"
    )
    revenue = with_revenue(occurrences).orderBy("file_fy", "revenue_rank")
    columns = ["file_fy", "violation_code", "occurrences", "total_fines_collected"]
    assert rows_of(revenue, *columns) == REVENUE
    assert dict(revenue.dtypes)["total_fines_collected"] == "bigint"


def test_average_fines(spark):
    averages = dict(rows_of(fine_schedule(spark), "violation_code", "average_fine"))
    assert averages == {14: 115, 21: 55, 36: 50, 38: 50}
    assert all((high + other) % 2 == 0 for _, high, other in FINES)


def test_a_code_without_a_price_has_no_revenue(make_stages):
    stages = make_stages(*[{"violation_code": c} for c in (99, 99, 99, 21, 21, 14, 5)])
    assert rows_of(top3_code_occurrences(stages)) == [
        (2015, 99, 3, 1), (2015, 21, 2, 2), (2015, 5, 1, 3),
    ]
    priced = with_revenue(top3_code_occurrences(stages)).orderBy("revenue_rank")
    assert rows_of(priced, "violation_code", "total_fines_collected") == [
        (21, 110), (5, None), (99, None),
    ]
    assert rows_of(top_revenue_code(stages)) == [(2015, 21, 110)]


def test_precinct_questions_on_a_small_table(make_stages):
    def tickets(precinct, codes):
        return [{"issuer_precinct": precinct, "violation_code": c} for c in codes]

    stages = make_stages(
        *tickets(0, [14, 14, 14, 36, 36]),
        *tickets(19, [14, 38, 38, None]),
        *tickets(18, [14, 14]),
        *tickets(7, [14]),
        *tickets(None, [14] * 9),
    )
    columns = ["precinct_rank", "issuer_precinct", "rank", "violation_code", "ticket_count"]
    assert rows_of(top10_codes_by_precinct(stages), *columns) == [
        (1, 0, 1, 14, 3), (1, 0, 2, 36, 2),
        (2, 19, 1, 38, 2), (2, 19, 2, 14, 1), (2, 19, 3, None, 0),
        (3, 18, 1, 14, 2),
    ]
    assert tickets_in_top_precincts(stages).count() == 11
    assert rows_of(common_codes_across_precincts(stages)) == [(2015, 14)]
    shares = {
        (r.issuer_precinct, r.violation_code): (r.precinct_share, r.year_share, r.concentration)
        for r in code_concentration(stages).collect()
    }
    assert shares[0, 36] == (2 / 5, 2 / 21, (2 / 5) / (2 / 21))
    assert shares[18, 14] == (1.0, 16 / 21, 1.0 / (16 / 21))
