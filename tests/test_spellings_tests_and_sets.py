"""Spelling roots, step-up tests and frequent sets against brute force."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from curbside.operators import (
    frequent_sets,
    likelihood_ratio,
    log_p_of_ratio,
    spelling_roots,
    step_up,
)
from tests.conftest import rows_of


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_roots(counts, factor):
    forms = {}
    for v, n in counts.items():
        near = [] if v is None else [
            (-m, w) for w, m in counts.items()
            if w is not None and m >= factor * n and one_apart(v, w)
        ]
        forms[v] = min(near)[1] if near else None
    rows = []
    for v, n in counts.items():
        root = v
        while forms[root] is not None:
            root = forms[root]
        rows.append((v, n, forms[v], root))
    return rows


@pytest.mark.parametrize("seed,factor", [(1, 10), (2, 2), (3, 3)])
def test_roots_equal_brute_force(spark, tmp_path, seed, factor):
    draw = random.Random(seed)
    counts = {None: 10**12, "": 3, "x" * 3000: 50, "x" * 2999: 1, "é": 40, "日本": 400, "日": 4}
    for _ in range(400):
        value = "".join(draw.choice("aabé") for _ in range(draw.randrange(1, 7)))
        counts[value] = draw.choice([1, 2, 5, 20, 100, 10**6])
    df = spark.createDataFrame(list(counts.items()), "v string, n bigint")
    got = rows_of(spelling_roots(df, "v", "n", str(tmp_path / "f"), factor))
    expected = brute_roots(counts, factor)
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert any(form != root for _, _, form, root in expected if form is not None)


def test_longest_chain_of_forms(spark, tmp_path):
    counts = {"a" * (i + 1): 2**i for i in range(62)}
    df = spark.createDataFrame(list(counts.items()), "v string, n bigint")
    roots = {r.root for r in spelling_roots(df, "v", "n", str(tmp_path / "f"), 2).collect()}
    assert roots == {"a" * 62}


def test_no_values_have_no_forms(spark, tmp_path):
    empty = spark.createDataFrame([], "v string, n bigint")
    assert rows_of(spelling_roots(empty, "v", "n", str(tmp_path / "f"))) == []
    with pytest.raises(ValueError):
        spelling_roots(empty, "v", "n", str(tmp_path / "g"), 1)


def brute_step_up(evidence, chance, rate):
    tests = len(evidence)
    ranks = [sum(o >= e for o in evidence) for e in evidence]
    passing = [
        e for e, r in zip(evidence, ranks, strict=True) if chance(e) <= math.log(rate * r / tests)
    ]
    least = min(passing, default=math.inf)
    return [(e, r, e >= least) for e, r in zip(evidence, ranks, strict=True)]


@pytest.mark.parametrize("slices", [2, 7, 200])
@pytest.mark.parametrize("seed", [1, 2])
def test_step_up_equals_brute_force(spark, tmp_path, seed, slices):
    """Group 1 has most rows and a third of them tie; group 3 rejects nothing."""
    draw = random.Random(seed)
    groups = {
        1: [draw.choice([4000, draw.randrange(9000)]) for _ in range(900)],
        None: [draw.randrange(20000) for _ in range(90)],
        3: [0] * 5,
    }
    rows = [(g, e) for g, of in groups.items() for e in of] + [(1, None), (4, None)]
    df = spark.createDataFrame(rows, "g int, e bigint")
    found = step_up(
        df, ["g"], "e", lambda e: -e / 1000.0, 0.05, str(tmp_path / "f"), slices
    )
    expected = [(1, None, None, False), (4, None, None, False)]
    for g, of in groups.items():
        expected += [(g, *row) for row in brute_step_up(of, lambda e: -e / 1000, 0.05)]
    assert sorted(rows_of(found), key=repr) == sorted(expected, key=repr)
    assert {r for g, _, _, r in expected if g == 1} == {True, False}


def test_no_rows_are_no_tests(spark, tmp_path):
    df = spark.createDataFrame([], "g int, e bigint")
    found = step_up(df, ["g"], "e", lambda e: -e / 1.0, 0.05, str(tmp_path / "f"))
    assert rows_of(found) == []


def test_chances_of_ratios(spark):
    ratios = [0.0, 1e-9, 0.5, 3.841459, 60.0, 900.0]
    df = spark.createDataFrame([(r,) for r in ratios], "g double")
    got = [r[0] for r in rows_of(df.select(log_p_of_ratio(F.col("g")).alias("p")))]
    for ratio, found in zip(ratios, got, strict=True):
        assert found == pytest.approx(math.log(math.erfc(math.sqrt(ratio / 2))), abs=2e-7)
    huge = spark.createDataFrame([(1e12,)], "g double").select(log_p_of_ratio(F.col("g")))
    assert -6e11 < huge.first()[0] < -4e11


def test_ratio_of_a_table_with_zeros(spark):
    rows = [(10, 10, 10, 40), (3, 10, 12, 40), (5, 10, 20, 40), (7, 7, 7, 7)]
    df = spark.createDataFrame(rows, "a bigint, r bigint, c bigint, n bigint")
    got = [r[0] for r in rows_of(df.select(likelihood_ratio(*map(F.col, "arcn")).alias("g")))]
    for (a, r, c, n), found in zip(rows, got, strict=True):
        cells = [(a, r, c), (r - a, r, n - c), (c - a, n - r, c), (n - r - c + a, n - r, n - c)]
        expected = 2 * sum(o * math.log(o * n / (x * y)) for o, x, y in cells if o)
        assert found == pytest.approx(expected, abs=1e-9)


def brute_sets(rows, percent):
    baskets = defaultdict(lambda: defaultdict(set))
    for g, b, i in rows:
        baskets[g][b].update([] if i is None else [i])
    found = []
    for g, of in baskets.items():
        support = Counter(
            s for items in of.values() for k in range(1, len(items) + 1)
            for s in itertools.combinations(sorted(items), k)
        )
        found += [
            (g, list(s), n, len(of), len(s)) for s, n in support.items()
            if n * 100 >= percent * len(of)
        ]
    return found


@pytest.mark.parametrize("percent", [4, 20, 70])
@pytest.mark.parametrize("seed", [1, 2])
def test_frequent_sets_equal_brute_force(spark, tmp_path, seed, percent):
    """A third of the baskets are copies, an item is in most, and there are nulls."""
    draw = random.Random(seed)
    rows = []
    for basket in range(90):
        group = draw.choice([1, 1, 1, None])
        items = [1, 2, 3, 5] if basket % 3 == 0 else [draw.randrange(9) for _ in range(5)]
        rows += [(group, basket or None, i) for i in [0, *items, *items[:2]] + [None]]
    rows += [(7, 1, None), (1, 1000, None)]
    df = spark.createDataFrame(rows, "g int, b int, i int")
    found = frequent_sets(df, ["g"], "b", "i", percent, str(tmp_path / "f"))
    got = [tuple(r) for r in found.select("g", "items", "support", "baskets", "size").collect()]
    assert sorted(got, key=repr) == sorted(brute_sets(rows, percent), key=repr)


def test_no_baskets_have_no_sets(spark, tmp_path):
    df = spark.createDataFrame([], "g int, b int, i int")
    found = frequent_sets(df, ["g"], "b", "i", 10, str(tmp_path / "f"))
    assert rows_of(found) == []
    assert found.columns == ["g", "items", "support", "baskets", "size"]
