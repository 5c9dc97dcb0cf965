"""Counts, states, addresses and most frequent values."""

from __future__ import annotations

import random
from collections import Counter

from curbside.operators import frequency, nested_top_k, top_k
from curbside.plans.examine import (
    distinct_states,
    missing_address_count,
    unique_state_count,
)
from curbside.plans.frequencies import top5_vehicle_make, top5_violation_code
from curbside.plans.source_tables import table_profile, ticket_preview
from curbside.plans.years import union_by_year, yearly_summary
from curbside.shared import stages_for
from tests.conftest import DATA, rows_of


def test_the_sentinel_is_listed_but_is_no_state(make_stages):
    stages = make_stages(
        {"registration_state": "NY"}, {"registration_state": "NJ"},
        {"registration_state": "99"}, {"registration_state": "NY"},
        {"registration_state": None},
    )
    states = {state for _, state in rows_of(distinct_states(stages))}
    assert states == {"NY", "NJ", "99", None}
    assert rows_of(unique_state_count(stages)) == [(2015, 2)]


def test_a_year_of_sentinels_has_no_state(make_stages):
    assert rows_of(unique_state_count(make_stages({"registration_state": "99"}))) == [(2015, 0)]


def test_one_part_makes_an_address(make_stages):
    none = {"house_number": None, "street_name": None, "intersecting_street": None}
    stages = make_stages(
        none, {**none, "street_name": "MAIN ST"}, {**none, "house_number": "1"},
        {**none, "intersecting_street": "ELM"},
    )
    assert rows_of(missing_address_count(stages)) == [(2015, 1)]
    assert rows_of(yearly_summary(stages)) == [(2015, 4, 1, 1)]


def test_years_without_a_fault_are_counted_as_zero(make_stages):
    assert rows_of(missing_address_count(make_stages({}))) == [(2015, 0)]


def test_the_null_group_is_listed_with_zero(make_stages):
    stages = make_stages(
        {"vehicle_make": None}, {"vehicle_make": None}, {"vehicle_make": "FORD"}
    )
    assert rows_of(top5_vehicle_make(stages)) == [(2015, "FORD", 1, 1), (2015, None, 0, 2)]


def test_the_lower_code_wins_a_tie(make_stages):
    codes = [1, 1, 2, 2, 3, 3, 4, 4, 9, 7]
    stages = make_stages(*[{"violation_code": c} for c in codes])
    assert rows_of(top5_violation_code(stages), "violation_code", "rank") == [
        (1, 1), (2, 2), (3, 3), (4, 4), (7, 5),
    ]


def test_union_of_years_is_the_grouped_result(spark):
    stages = stages_for(spark, f"{DATA}/sf0.01")
    assert sorted(rows_of(union_by_year(stages))) == sorted(
        rows_of(top5_violation_code(stages))
    )


def cells(spark, seed):
    """Random (year, group, member) rows, a third of them in one group."""
    pick = random.Random(seed)
    rows = [
        (
            pick.choice([2015, 2016]),
            0 if pick.random() < 0.34 else pick.choice([None, *range(1, 9)]),
            pick.choice([None, *range(12)]),
        )
        for _ in range(3000)
    ]
    return rows, spark.createDataFrame(rows, "y int, g int, m int").repartition(6)


def ranked(counts: Counter, k: int) -> list:
    """Largest counts, ties by ascending value with nulls first."""

    def order(item):
        value, count = item
        return -count, (value is not None, value or 0)

    return sorted(counts.items(), key=order)[:k]


def test_top_k_matches_brute_force(spark):
    rows, df = cells(spark, seed=1)
    got = rows_of(top_k(frequency(df, ["y", "g"]), ["y"], ["g"], 4), "y", "rank", "g", "ticket_count")
    expected = [
        (year, rank, g, n)
        for year in (2015, 2016)
        for rank, (g, n) in enumerate(ranked(Counter(g for y, g, _ in rows if y == year), 4), 1)
    ]
    assert sorted(got) == sorted(expected)


def test_nested_top_k_matches_brute_force(spark):
    rows, df = cells(spark, seed=2)
    for count_nulls in (True, False):
        nested = nested_top_k(
            frequency(df, ["y", "g", "m"]), "y", "g", "m", 3, 5, count_nulls=count_nulls
        )
        got = rows_of(nested, "y", "group_rank", "g", "group_count", "rank", "m", "ticket_count")
        expected = []
        for year in (2015, 2016):
            groups, members = Counter(), Counter()
            for y, g, m in rows:
                if y == year:
                    groups[g] += count_nulls or g is not None
                    members[g, m] += count_nulls or m is not None
            for group_rank, (g, total) in enumerate(ranked(groups, 3), 1):
                if g is not None:
                    inner = Counter({m: n for (of, m), n in members.items() if of == g})
                    for rank, (m, n) in enumerate(ranked(inner, 5), 1):
                        expected.append((year, group_rank, g, total, rank, m, n))
        assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_profile_counts_values_and_distinct_values(make_stages):
    stages = make_stages(
        {"vehicle_make": "FORD"}, {"vehicle_make": "FORD"}, {"vehicle_make": None},
        {"vehicle_make": "HONDA"},
    )
    profile = {r.column_name: r for r in table_profile(stages).collect()}
    assert len(profile) == 12
    make, key = profile["vehicle_make"], profile["summons_number"]
    assert (make.data_type, make.non_null_count, make.distinct_count) == ("string", 3, 2)
    assert (key.data_type, key.non_null_count, key.distinct_count) == ("bigint", 4, 4)


def test_preview_shows_first_keys_of_each_year(make_stages):
    stages = make_stages(
        *[{"summons_number": n} for n in (9, 3, None, 5, 8, 4, 7, 6)], {"file_fy": 2016}
    )
    got = rows_of(ticket_preview(stages), "file_fy", "summons_number")
    assert sorted(got) == [*[(2015, n) for n in (3, 4, 5, 6, 7, 8)], (2016, 9)]
