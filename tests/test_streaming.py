"""The stream of files against one pass over all of them."""

from __future__ import annotations

import datetime as dt

import pytest

from curbside import TicketStages
from curbside.incremental import IncrementalTickets
from curbside.plans.intake import BATCHES, streamed_dedup
from curbside.streaming import StreamIntake
from tests.conftest import SCHEMA, rows_of


def batches():
    """Three files: copies within and across files, a key with a third of all rows,
    null keys and dates, a ticket long before the others."""
    hot = [{"summons_number": 7, "issue_date": f"10/{d:02d}/2014"} for d in range(20, 29)]
    first = [{"summons_number": i, "vehicle_make": "FORD"} for i in range(1, 6)]
    second = [
        *hot, {"summons_number": 2, "vehicle_make": "AUDI"}, {"summons_number": None},
        {"summons_number": 30, "issue_date": "7/2/2014"},
    ]
    third = [
        {"summons_number": 7, "issue_date": "10/01/2014"}, {"summons_number": 40, "issue_date": None},
        {"summons_number": None, "vehicle_make": None}, {"summons_number": 41, "file_fy": 2016},
        {"summons_number": 3, "issue_date": "7/3/2014"},
    ]
    return [first, second, third]


@pytest.fixture
def files(spark, make_tickets, tmp_path):
    folder = tmp_path / "files"

    def write(number):
        part = make_tickets(*batches()[number]).coalesce(1)
        part.write.mode("append").parquet(str(folder))

    return folder, write


def stream(spark, folder):
    reader = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
    return reader.parquet(str(folder))


def expected(make_tickets):
    rows = [row for part in batches() for row in part]
    return sorted(rows_of(TicketStages(make_tickets(*rows)).deduplicated()), key=repr)


def found(intake, make_tickets):
    columns = TicketStages(make_tickets({})).deduplicated().columns
    return sorted(rows_of(intake.tickets(), *columns), key=repr)


def test_files_that_arrive_make_the_table_of_one_pass(spark, make_tickets, files, tmp_path):
    folder, write = files
    path = str(tmp_path / "intake")
    for number in range(3):
        write(number)
        # A new object each time: what is known lies in the checkpoint and table.
        StreamIntake(spark, path, 30, 2).run(stream(spark, folder)).awaitTermination()
    intake = StreamIntake(spark, path, 30, 2)
    assert found(intake, make_tickets) == expected(make_tickets)
    entries = sorted(rows_of(intake.ledger(), "batch", "rows", "late", "latest"))
    day = dt.date(2014, 10, 28)
    assert entries == [
        (0, 5, 0, dt.date(2014, 10, 1)), (1, 12, 1, day), (2, 5, 1, dt.date(2014, 10, 1))
    ]
    # Without a new file nothing is taken in again.
    intake.run(stream(spark, folder)).awaitTermination()
    assert intake.ledger().count() == 3


@pytest.mark.parametrize("after", ["before the table", "behind the table"])
def test_a_batch_cut_off_is_neither_lost_nor_repeated(
    spark, make_tickets, files, tmp_path, monkeypatch, after
):
    folder, write = files
    path = str(tmp_path / "intake")
    write(0)
    StreamIntake(spark, path, 30, 2).run(stream(spark, folder)).awaitTermination()
    write(1)
    write(2)
    add = IncrementalTickets.add

    def cut_off(self, tickets):
        if after == "behind the table":
            add(self, tickets)
        raise RuntimeError("executors lost")

    monkeypatch.setattr(IncrementalTickets, "add", cut_off)
    with pytest.raises(Exception, match="executors lost"):
        StreamIntake(spark, path, 30, 2).run(stream(spark, folder)).awaitTermination()
    monkeypatch.setattr(IncrementalTickets, "add", add)
    intake = StreamIntake(spark, path, 30, 2)
    intake.run(stream(spark, folder)).awaitTermination()
    assert found(intake, make_tickets) == expected(make_tickets)
    assert sum(r.rows for r in intake.ledger().collect()) == 22


def test_a_batch_in_the_ledger_is_passed_over(spark, make_tickets, tmp_path):
    intake = StreamIntake(spark, str(tmp_path / "intake"), 30, 2)
    assert intake.tickets() is None and intake.ledger().count() == 0
    tickets = make_tickets(*batches()[0])
    intake.take(tickets, 0)
    intake.take(tickets, 0)
    assert rows_of(intake.ledger(), "batch", "rows") == [(0, 5)]
    assert intake.tickets().count() == 5


def test_batches_do_not_grow_with_the_files(spark, make_tickets, make_stages, monkeypatch):
    rows = [row for part in batches() for row in part]
    take, taken = StreamIntake.take, []

    def counted(self, tickets, batch):
        taken.append(batch)
        take(self, tickets, batch)

    monkeypatch.setattr(StreamIntake, "take", counted)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "2")
    try:
        stages = make_stages(*rows)
        found = streamed_dedup(stages)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert taken == list(range(BATCHES))
    columns = TicketStages(make_tickets({})).deduplicated().columns
    assert sorted(rows_of(found, *columns), key=repr) == expected(make_tickets)


def test_no_tickets_are_taken_in_as_none(make_tickets):
    found = streamed_dedup(TicketStages(make_tickets({}).limit(0)))
    assert found.columns == TicketStages(make_tickets({})).deduplicated().columns
    assert found.count() == 0
