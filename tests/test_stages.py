"""Deduplication and the date filter, on tickets with every fault."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from curbside import REGISTRY, TicketStages, read_stages, write_stages
from curbside.operators import keep_first
from curbside.plans.cleaning import (
    dedup_ticket_count,
    invalid_issue_date_count,
    invalid_issue_date_share,
    issue_year_distribution,
    set_aside_count,
)
from curbside.schema import FISCAL_YEAR, KEY, SURVIVOR_ORDER
from curbside import shared
from curbside.shared import PreparedStages, listing, prepared_stages_for, stages_for
from curbside.stages import shuffle_partitions_for
from tests.conftest import DATA, rows_of


# As it is; the session's fixture may put another in its place.
_shared_folder = shared.shared_folder


def keys(df):
    return sorted(r[0] for r in df.select(KEY).collect())


def test_fiscal_year_includes_both_ends(make_stages):
    stages = make_stages(
        {"issue_date": "07/01/2014"},
        {"issue_date": "06/30/2015"},
        {"issue_date": "06/30/2014"},
        {"issue_date": "07/01/2015"},
    )
    assert keys(stages.clean()) == [1, 2]
    assert rows_of(invalid_issue_date_count(stages)) == [(2015, 2)]
    assert rows_of(invalid_issue_date_share(stages)) == [(2015, 2, 4, 0.5)]


def test_unreadable_dates_are_neither_valid_nor_invalid(make_stages):
    stages = make_stages(
        {"issue_date": None},
        {"issue_date": "junk"},
        {"issue_date": "13/45/2015"},
        {"issue_date": "02/30/2015"},
        {"issue_date": "9/8/2014"},
        {"issue_date": "09/08/2014"},
        {"summons_number": None},
        {},
    )
    assert sorted(rows_of(stages.valid(KEY), KEY), key=str) == [(5,), (6,), (8,), (None,)]
    assert keys(stages.clean()) == [5, 6, 8]
    assert rows_of(invalid_issue_date_count(stages)) == [(2015, 0)]
    assert rows_of(issue_year_distribution(stages)) == [(2015, None, 4), (2015, 2014, 4)]
    assert rows_of(set_aside_count(stages)) == [(2015, 4, 1)]


def test_a_copy_out_of_range_can_win_over_a_valid_one(make_stages):
    stages = make_stages(
        {"summons_number": 7, "issue_date": "10/01/2014"},
        {"summons_number": 7, "issue_date": "07/01/2015"},
    )
    assert rows_of(stages.deduplicated(), "issue_date") == [("07/01/2015",)]
    assert keys(stages.clean()) == []


def test_keys_are_unique_per_file(make_stages):
    stages = make_stages(
        {"summons_number": 7},
        {"summons_number": 7, "file_fy": 2016, "issue_date": "10/01/2015"},
    )
    assert sorted(rows_of(stages.clean(), FISCAL_YEAR, KEY)) == [(2015, 7), (2016, 7)]


def test_null_keys_are_one_ticket_until_they_are_dropped(make_stages):
    stages = make_stages({"summons_number": None}, {"summons_number": None}, {})
    assert rows_of(dedup_ticket_count(stages)) == [(2015, 2)]
    assert stages.valid().count() == 2
    assert keys(stages.clean()) == [3]


def random_tickets(seed: int, count: int, hot: float) -> list[dict]:
    """Tickets with few distinct values, a part of them with one key."""
    pick = random.Random(seed)
    return [
        {
            "summons_number": 1 if pick.random() < hot else pick.choice([None, *range(2, 40)]),
            "issue_date": pick.choice([None, "10/01/2014", "07/01/2015", "junk"]),
            "violation_code": pick.choice([None, 14, 21]),
            "violation_time": pick.choice([None, "0953A", "0954A"]),
            "vehicle_make": pick.choice([None, "FORD", "HONDA"]),
            "house_number": pick.choice([None, "1", "2"]),
            "file_fy": pick.choice([2015, 2016]),
        }
        for _ in range(count)
    ]


def smallest_copies(rows):
    """Per key the smallest row in survivor order, nulls first."""
    first = {}
    for row in rows:
        values = [row[c] for c in SURVIVOR_ORDER]
        order = [(v is not None, v if v is not None else 0) for v in values]
        key = row[FISCAL_YEAR], row[KEY]
        if key not in first or order < first[key][0]:
            first[key] = order, values
    return {(*key, *values) for key, (_, values) in first.items()}


def test_survivors_match_brute_force_with_a_hot_key(make_tickets):
    tickets = make_tickets(*random_tickets(seed=3, count=900, hot=0.4)).repartition(7)
    rows = [r.asDict() for r in tickets.collect()]
    kept = TicketStages(tickets, (2015, 2016)).deduplicated()
    got = rows_of(kept, FISCAL_YEAR, KEY, *SURVIVOR_ORDER)
    assert len(got) == len(set(got))
    assert set(got) == smallest_copies(rows)


def test_survivors_do_not_depend_on_the_columns_asked_for(make_tickets):
    tickets = make_tickets(*random_tickets(seed=5, count=600, hot=0.3)).repartition(5)
    whole = keep_first(tickets, [FISCAL_YEAR, KEY], SURVIVOR_ORDER)
    for column in SURVIVOR_ORDER:
        some = keep_first(tickets, [FISCAL_YEAR, KEY], SURVIVOR_ORDER, {column})
        wanted = [FISCAL_YEAR, KEY, column]
        assert set(rows_of(some, *wanted)) == set(rows_of(whole, *wanted))
    only_keys = keep_first(tickets, [FISCAL_YEAR, KEY], SURVIVOR_ORDER, set())
    assert set(rows_of(only_keys)) == set(rows_of(whole, FISCAL_YEAR, KEY))


def test_other_columns_survive_with_their_ticket(make_tickets):
    tickets = make_tickets({"summons_number": 7}, {"summons_number": 7}, {"summons_number": 8})
    noted = tickets.withColumn("note", F.lit("b")).unionByName(
        tickets.withColumn("note", F.lit("a"))
    )
    kept = TicketStages(noted, (2015,)).clean(KEY, "note")
    assert sorted(rows_of(kept, KEY, "note")) == [(7, "a"), (8, "a")]


def test_written_stages_give_the_same_rows(make_tickets, tmp_path):
    tickets = make_tickets(*random_tickets(seed=9, count=500, hot=0.2))
    computed = TicketStages(tickets, (2015, 2016))
    write_stages(computed, f"{tmp_path}/tickets")
    stored = read_stages(tickets, f"{tmp_path}/tickets")
    for stage in ("raw", "deduplicated", "valid", "clean"):
        expected, got = getattr(computed, stage)(), getattr(stored, stage)()
        assert got.schema == expected.schema
        assert sorted(rows_of(got), key=repr) == sorted(rows_of(expected), key=repr)
    assert rows_of(stored.clean()), "the sample has clean tickets"
    assert stored.years == computed.years == TicketStages(tickets).years == [2015, 2016]


def test_an_empty_source_gives_empty_stages(make_tickets, tmp_path):
    none = make_tickets({}).filter("false")
    computed = TicketStages(none, (2015,))
    write_stages(computed, f"{tmp_path}/none")
    assert rows_of(read_stages(none, f"{tmp_path}/none").clean()) == []
    assert rows_of(computed.clean()) == []


def test_the_shared_table_is_written_once_per_session(spark):
    stages = prepared_stages_for(spark, f"{DATA}/sf0.001")
    assert isinstance(stages, PreparedStages)
    assert stages_for(spark, f"{DATA}/sf0.001") is stages
    files = stages.deduplicated().inputFiles()
    assert prepared_stages_for(spark, f"{DATA}/sf0.001").deduplicated().inputFiles() == files
    assert all(shared.shared_folder(spark) in f for f in files)
    assert stages.clean().inputFiles() and set(stages.clean().inputFiles()) <= set(files)


def test_a_failed_write_leaves_nothing_and_can_be_tried_again(make_tickets, tmp_path):
    tickets = make_tickets({}, {})
    bad = tickets.withColumn("violation_code", F.raise_error("lost").cast("int"))
    stages = PreparedStages(bad, str(tmp_path), 0)
    with pytest.raises(Exception, match="lost"):
        stages.prepare()
    assert not list(tmp_path.iterdir())
    stages._raw = tickets
    assert stages.prepare().clean().count() == 2


def test_large_sources_get_more_shuffle_partitions():
    assert shuffle_partitions_for(0, 8) == 8
    assert shuffle_partitions_for(10 * 1024**3, 8) == 20
    assert shuffle_partitions_for(10 * 1024**3, 200) == 200
    assert shuffle_partitions_for(100 * 1024**4, 200) == 204_800
    assert shuffle_partitions_for(100 * 1024**4, 200, target_bytes=1024**3) == 102_400


def test_writing_leaves_the_session_as_it_was(spark, make_tickets, tmp_path, monkeypatch):
    setting = "spark.sql.shuffle.partitions"
    before, during = spark.conf.get(setting), []
    raw = TicketStages.raw

    def watched(self, *columns):
        during.append(spark.conf.get(setting))
        return raw(self, *columns)

    monkeypatch.setattr(TicketStages, "raw", watched)
    plain = make_tickets({}, {})
    # The task that reads a ticket sees the setting the write goes by.
    write_stages(TicketStages(plain), f"{tmp_path}/tickets", source_bytes=20 * 1024**3)
    assert set(during) == {before} and spark.conf.get(setting) == before


def test_files_follow_the_size_and_not_the_partitions(spark, make_tickets, tmp_path):
    """With coalescing off and very many partitions sorted."""
    tickets = make_tickets(*random_tickets(seed=11, count=2000, hot=0.1))
    settings = {
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "64",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        write_stages(TicketStages(tickets), f"{tmp_path}/tickets")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    files = list(tmp_path.glob("tickets/*/*/*.parquet"))
    folders = {f.parent for f in files}
    assert len(files) <= 2 * len(folders)


def test_new_files_of_the_source_are_seen(spark, tmp_path):
    for name in shared.SOURCE_TABLES:
        spark.read.parquet(f"{DATA}/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    count = "raw_ticket_count"
    before = sum(r.ticket_count for r in REGISTRY[count].build(
        prepared_stages_for(spark, str(tmp_path))).collect())
    kept = prepared_stages_for(spark, str(tmp_path)).deduplicated().count()
    more = spark.read.parquet(f"{DATA}/sf0.001/lineitem.parquet").withColumn(
        "l_orderkey", F.col("l_orderkey") + 10**7
    )
    more.write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")
    stages = prepared_stages_for(spark, str(tmp_path))
    after = sum(r.ticket_count for r in REGISTRY[count].build(stages).collect())
    assert after == 2 * before
    assert stages.deduplicated().count() > 1.5 * kept


def test_size_of_a_source(spark):
    path = f"{DATA}/sf0.01/lineitem.parquet"
    assert listing(spark, [path])[0] == os.path.getsize(path)


@pytest.mark.parametrize(
    "master, folder, usable",
    [("local[8]", "/tmp/x", True), ("local-cluster[2,1,1024]", "file:///tmp/x", True),
     ("yarn", "/tmp/x", False), ("spark://h:7077", "file:///tmp/x", False),
     ("yarn", "hdfs://h/x", True)],
)
def test_a_local_folder_is_not_shared_on_a_cluster(master, folder, usable):
    class Session:
        class conf:
            get = staticmethod(lambda name, default: folder)

        class sparkContext:
            pass

    Session.sparkContext.master = master
    assert _shared_folder(Session) == (folder if usable else None)


def test_without_a_shared_folder_stages_are_computed(spark, monkeypatch):
    monkeypatch.setattr("curbside.shared.shared_folder", lambda spark: None)
    stages = stages_for(spark, f"{DATA}/sf0.001/")
    assert type(stages) is TicketStages


def test_counts_add_up(spark):
    stages = prepared_stages_for(spark, f"{DATA}/sf0.01")
    statuses = stages.deduplicated("ticket_status").groupBy("file_fy").pivot("ticket_status")
    for row in statuses.count().na.fill(0).collect():
        year = F.col("file_fy") == row.file_fy
        assert stages.clean().filter(year).count() == row.clean
        assert stages.valid().filter(year).count() == row.clean + row.keyless
        assert stages.deduplicated().filter(year).count() == sum(row[1:])


def test_queries_that_write_run_on_a_cluster_without_a_shared_uri(spark, tmp_path, monkeypatch):
    """By the named folder, or the warehouse, if what all tasks write there is found."""
    settings = {"spark.checkpoint.dir": f"file://{tmp_path}/named"}

    class Session:
        range, read, _jvm, _jsc = spark.range, spark.read, spark._jvm, spark._jsc

        class conf:
            get = staticmethod(lambda name, default: settings.get(name, default))

        class sparkContext:
            master, defaultParallelism = "spark://h:7077", 4
            getCheckpointDir = staticmethod(lambda: None)

    monkeypatch.setattr(shared, "shared_folder", _shared_folder)
    assert shared.work_folder(Session()) == f"file://{tmp_path}/named"
    settings = {"spark.sql.warehouse.dir": f"{tmp_path}/tables/"}
    assert shared.work_folder(Session()) == f"{tmp_path}/tables/curbside-work"
    assert not list(tmp_path.glob("**/reached-*"))

    class Lost(Session):
        """Its executors write to disks of their own."""

        range = staticmethod(lambda start, end, step, parts: spark.range(0, end - 1, step, parts))

    with pytest.raises(ValueError, match="executors share"):
        shared.work_folder(Lost())
    (tmp_path / "file").write_text("")
    settings = {"spark.checkpoint.dir": f"{tmp_path}/file"}
    with pytest.raises(ValueError, match="executors share"):
        shared.work_folder(Session())


@pytest.mark.parametrize(
    "name",
    ["common_code_sets", "incremental_dedup", "issue_date_quantiles", "significant_codes",
     "streamed_dedup", "top5_cleaned_body_type"],
)
def test_queries_that_write_compute_the_tickets_once(spark, monkeypatch, name):
    """Of all they write and return, one plan alone reads the order tables."""
    monkeypatch.setattr("curbside.shared.shared_folder", lambda spark: None)
    stages = stages_for(spark, f"{DATA}/sf0.001/")
    written, write = [], DataFrameWriter.parquet

    def recorded(writer, path, *args, **options):
        written.append(writer._df)
        write(writer, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", recorded)
    found = REGISTRY[name].build(stages)
    assert found.count()
    reading = [df for df in (*written, found) if any("lineitem" in f for f in df.inputFiles())]
    assert len(reading) == 1
