"""The plans Spark makes of the queries."""

from __future__ import annotations

import re

import pytest

from curbside import REGISTRY, TicketStages, register_views
from curbside.shared import SOURCE_TABLES, prepared_stages_for, stages_for, ticket_reader
from tests.conftest import DATA


def executed(df) -> str:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0] if "Final Plan" in plan else plan


def planned(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    return prepared_stages_for(spark, f"{DATA}/sf0.001")


@pytest.fixture(scope="module")
def computed(spark):
    raw, read = ticket_reader(spark, f"{DATA}/sf0.001")
    return TicketStages(raw, read=read)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_no_python_and_no_cross_join(stored, computed, name):
    for stages in (stored, computed):
        plan = planned(REGISTRY[name].build(stages))
        for node in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"):
            assert node not in plan


@pytest.mark.parametrize("name", list(REGISTRY))
def test_queries_of_the_shared_table_do_not_deduplicate(stored, name):
    if name not in ("raw_ticket_count", "table_profile", "ticket_preview"):
        plan = planned(REGISTRY[name].build(stored))
        assert "SortAggregate" not in plan and "lineitem" not in plan


@pytest.mark.parametrize(
    "name",
    [n for n in REGISTRY if re.match(r"top\d+_(?!code_occ)", n)] + ["top3_code_occurrences"],
)
def test_ranking_is_limited_before_the_shuffle(stored, name):
    plan = planned(REGISTRY[name].build(stored))
    assert re.search(r"WindowGroupLimit.*Partial", plan)
    assert re.search(r"WindowGroupLimit.*Final", plan)


@pytest.mark.parametrize(
    "name",
    ["tickets_in_top_precincts", "top3_bins_by_top_code", "top10_codes_by_precinct",
     "fine_schedule", "fine_revenue", "code_concentration"],
)
def test_small_sides_are_broadcast(stored, name):
    plan = planned(REGISTRY[name].build(stored))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize(
    "name",
    ["top3_bins_by_top_code", "top10_codes_by_precinct", "common_codes_across_precincts",
     "code_concentration"],
)
def test_nested_rankings_scan_tickets_once(stored, computed, name):
    for stages in (stored, computed):
        plan = executed(REGISTRY[name].build(stages))
        scan = r"FileScan parquet" if stages is stored else r"FileScan parquet \[l_"
        assert len(re.findall(scan, plan)) == 1
        assert "ReusedExchange" in plan


def test_the_shared_table_is_pruned_to_folders_and_columns(stored):
    plan = REGISTRY["top5_violation_code"].build(stored)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<violation_code:int>" in text
    assert re.search(r"PartitionFilters: \[[^\]]*ticket_status", text)


def jobs_of(spark, make):
    """What ``make`` returns, and the number of jobs it ran."""
    spark.sparkContext.setJobGroup("counted", "counted")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    made = make()
    after = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    spark.sparkContext.setJobGroup("others", "others")
    return made, after - before


def test_years_side_by_side_scan_tickets_once(spark, stored, computed):
    rows = sorted(map(tuple, REGISTRY["top5_violation_code"].build(stored).select(
        "file_fy", "violation_code", "ticket_count", "rank").collect()))
    df, jobs = jobs_of(spark, lambda: REGISTRY["union_by_year"].build(stored))
    assert jobs == 0 and sorted(map(tuple, df.collect())) == rows
    known = TicketStages(computed._raw, stored.years, computed._read)
    df, jobs = jobs_of(spark, lambda: REGISTRY["union_by_year"].build(known))
    assert jobs == 0 and sorted(map(tuple, df.collect())) == rows
    for of, scan in ((stored, "FileScan"), (known, "FileScan parquet [l_")):
        assert executed(REGISTRY["union_by_year"].build(of)).count(scan) == 1


@pytest.mark.parametrize(
    "name", ["raw_ticket_count", "hour_distribution", "top5_violation_code", "issue_year_distribution"]
)
def test_only_the_dimensions_in_use_are_joined(computed, name):
    plan = planned(REGISTRY[name].build(computed))
    assert "lineitem" in plan and "Join" not in plan


def test_registering_views_runs_no_job(spark, tmp_path):
    for name in SOURCE_TABLES:
        spark.read.parquet(f"{DATA}/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    stages = stages_for(spark, str(tmp_path))
    _, jobs = jobs_of(spark, lambda: register_views(stages))
    assert jobs == 0


def test_computing_stages_shuffles_only_the_columns_in_use(computed):
    plan = planned(REGISTRY["top5_violation_code"].build(computed))
    compared = re.search(r"partial_min\(struct\((.*?)\)\)", plan).group(1)
    assert "violation_code" in compared and "violation_time" not in compared


def test_the_null_key_is_dropped_before_deduplication(computed):
    plan = planned(REGISTRY["total_tickets"].build(computed))
    below = plan[plan.rindex("partial_min"):]
    assert re.search(r"Filter .*211", below)


def test_the_preview_sorts_keys_alone(computed):
    plan = planned(REGISTRY["ticket_preview"].build(computed))
    assert re.search(r"WindowGroupLimit.*6, Partial", plan)
    # Whole rows meet the bound of the keys before they are ranked.
    whole = plan.index("WindowGroupLimit")
    assert whole < re.search(r"BroadcastHashJoin.*LeftSemi", plan).start()
    assert plan.rindex("WindowGroupLimit") > plan.index("LeftSemi")


def test_source_joins_do_not_depend_on_broadcasts(spark, computed, duck):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        df = REGISTRY["top5_vehicle_make"].build(computed)
        got, plan = df.collect(), planned(df)
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert plan.count("SortMergeJoin") == 3
    expected = duck("sf0.001").sql(REGISTRY["top5_vehicle_make"].sql).fetchall()
    columns = ["file_fy", "vehicle_make", "ticket_count", "rank"]
    assert sorted((tuple(r[c] for c in columns) for r in got), key=repr) == sorted(
        expected, key=repr
    )
