"""Sketches with their exact second pass, and quantiles, against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from curbside.operators import (
    count_error,
    distinct_estimates,
    exact_quantiles,
    listed_values,
    merge_states,
    sketch_states,
    sketched_top_k,
)
from tests.conftest import rows_of

TRACKED = 24
SKETCHED = "g int, part int, skewed string, even int, empty string"


def sketched_rows(seed, count=6000):
    """Group 1 has most rows; ``skewed`` has a value on a third of them and a long
    tail, ``even`` no frequent value at all, and all have nulls."""
    draw = random.Random(seed)
    rows = []
    for i in range(count):
        skewed = draw.choice(["hot", f"w{draw.randrange(6)}", f"t{draw.randrange(2000)}", None])
        even = draw.choice([draw.randrange(700), draw.randrange(700), None])
        rows.append((draw.choice([1, 1, 1, 2, None]), i % 5, skewed, even, None))
    return rows


def brute_top(rows, k, columns):
    counts = defaultdict(Counter)
    for g, _, *values in rows:
        for name, value in zip(("skewed", "even", "empty"), values):
            if value is not None and name in columns:
                counts[g, name][str(value)] += 1
    out = []
    for (g, name), of in counts.items():
        ranked = sorted(of.items(), key=lambda item: (-item[1], item[0].encode()))[:k]
        out += [(g, name, v, n, i, sum(of.values())) for i, (v, n) in enumerate(ranked, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("k", [1, 5, 40])
def test_top_values_of_merged_states_are_exact(spark, seed, k):
    rows = sketched_rows(seed)
    df = spark.createDataFrame(rows, SKETCHED).repartition(4)
    columns = ["skewed", "even", "empty"]
    parts = sketch_states(df, ["g", "part"], columns, TRACKED)
    states = merge_states(parts, ["g"], columns, TRACKED)
    found = sketched_top_k(df, states, ["g"], columns, k, TRACKED)
    got = rows_of(found, "g", "column_name", "value", "ticket_count", "rank", "n")
    assert sorted(got, key=repr) == brute_top(rows, k, columns)


def test_states_are_bounded_and_within_their_error(spark):
    rows = sketched_rows(3)
    df = spark.createDataFrame(rows, SKETCHED)
    columns = ["skewed", "even"]
    parts = sketch_states(df, ["g", "part"], columns, TRACKED)
    states = merge_states(parts, ["g"], columns, TRACKED)
    exact = defaultdict(Counter)
    for g, _, skewed, even, _ in rows:
        for name, value in (("skewed", skewed), ("even", even)):
            if value is not None:
                exact[g, name][str(value)] += 1
    listed = defaultdict(dict)
    for r in listed_values(states, ["g"], columns, TRACKED).collect():
        listed[r.g, r.column_name][r.value] = r.estimate
    for of, counts in exact.items():
        error = count_error(sum(counts.values()), TRACKED)
        assert len(listed[of]) <= TRACKED
        for value, n in counts.items():
            assert abs(listed[of].get(value, 0) - n) <= error
    for r in distinct_estimates(states, ["g"], columns).collect():
        true = len(exact[r.g, r.column_name])
        assert abs(r.distinct_estimate - true) <= 0.08 * true


def test_most_frequent_values_need_no_full_count(spark):
    """What the states prove is answered by the second pass: values that are not
    listed are not counted."""
    rows = [(1, 0, "a" if i % 2 else f"t{i}", None, None) for i in range(4000)]
    df = spark.createDataFrame(rows, SKETCHED)
    states = sketch_states(df, ["g"], ["skewed"], TRACKED)
    assert listed_values(states, ["g"], ["skewed"], TRACKED).count() <= TRACKED
    top = sketched_top_k(df, states, ["g"], ["skewed"], 1, TRACKED)
    assert rows_of(top, "value", "ticket_count", "n") == [("a", 2000, 4000)]


def test_no_rows_have_no_states(spark):
    df = spark.createDataFrame([], SKETCHED)
    states = sketch_states(df, ["g"], ["skewed"], TRACKED)
    assert states.count() == 0
    assert sketched_top_k(df, states, ["g"], ["skewed"], 3, TRACKED).count() == 0


PERCENTS = [0, 1, 25, 50, 99, 100]


def brute_quantiles(rows):
    groups = defaultdict(list)
    for g, v in rows:
        if v is not None:
            groups[g].append(v)
    return sorted(
        (
            (g, p, sorted(of)[max(1, -(-len(of) * p // 100)) - 1])
            for g, of in groups.items() for p in PERCENTS
        ),
        key=repr,
    )


@pytest.mark.parametrize("kind, most", [("smallint", 2**15), ("int", 2**31), ("bigint", 2**63)])
def test_quantiles_equal_sorting(spark, tmp_path, kind, most):
    draw = random.Random(most)
    # A third of all rows in one group with one value, ends of the type, nulls.
    rows = [(1, 7)] * 700 + [(2, -most), (2, most - 1), (3, None), (4, -1), (4, 0)]
    for _ in range(1400):
        size = draw.choice([3, 300, most])
        rows.append((draw.choice([1, 2, None]), draw.choice([draw.randrange(-size, size), None])))
    df = spark.createDataFrame(rows, "g int, v bigint").withColumn("v", F.col("v").cast(kind))
    found = exact_quantiles(df, ["g"], "v", PERCENTS, str(tmp_path / "parts"))
    assert dict(found.dtypes)["value"] == kind
    assert sorted(rows_of(found, "g", "percent", "value"), key=repr) == brute_quantiles(rows)


def test_quantiles_of_nothing_and_of_text(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "g int, v int")
    assert rows_of(exact_quantiles(df, ["g"], "v", [50], str(tmp_path / "a"))) == []
    with pytest.raises(ValueError, match="no whole number"):
        exact_quantiles(df.withColumn("v", F.lit("x")), ["g"], "v", [50], str(tmp_path / "b"))


def test_quantiles_of_counted_values(spark, tmp_path):
    """Rows that stand for several values give what those values give one by one."""
    counts = [(1, 5, 3), (1, 70_000, 1), (1, None, 9), (2, -4, 1), (2, 6, 99), (None, 1, 2)]
    each = [(g, v) for g, v, n in counts for _ in range(n)]
    df = spark.createDataFrame(counts, "g int, v int, n int")
    found = exact_quantiles(df, ["g"], "v", PERCENTS, str(tmp_path / "parts"), weight="n")
    assert sorted(rows_of(found, "g", "percent", "value"), key=repr) == brute_quantiles(each)
