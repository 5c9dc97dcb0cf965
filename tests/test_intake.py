"""Files added one after another give what one run over all gives."""

from __future__ import annotations

import pytest

from curbside import TicketStages
from curbside.incremental import IncrementalTickets
from tests.conftest import rows_of


@pytest.fixture
def table(spark, tmp_path):
    return IncrementalTickets(spark, str(tmp_path / "table"), buckets=8, filter_bits=1 << 12)


def same(table, *files):
    whole = files[0]
    for file in files[1:]:
        whole = whole.unionByName(file)
    stages = TicketStages(whole)
    expected = rows_of(stages.deduplicated(), "file_fy", *stages.columns)
    assert sorted(rows_of(table.tickets(), "file_fy", *stages.columns), key=repr) == sorted(
        expected, key=repr
    )


def test_three_added_files_give_the_survivors_of_one_run(make_tickets, table):
    # A third of all tickets share one key, some have none.
    def file(shift):
        return make_tickets(*[
            {
                "summons_number": 7 if i % 3 == 0 else None if i % 11 == 0 else i + shift,
                "violation_code": (i * 7 + shift) % 50,
                "issue_date": f"{1 + (i + shift) % 12:02d}/0{1 + i % 9}/2014",
                "file_fy": 2015 + i % 2,
            }
            for i in range(60)
        ])

    files = [file(0), file(20), file(500), file(0)]
    for n, added in enumerate(files, 1):
        table.add(added)
        same(table, *files[:n])


def test_only_buckets_with_a_known_key_are_rewritten(spark, make_tickets, table):
    base = make_tickets(*[{"summons_number": i} for i in range(200)])
    table.add(base)
    before = set(table.folders)
    again = make_tickets({"summons_number": 5, "issue_date": "01/01/2015", "violation_code": 1})
    rewritten = table.add(again)
    assert len(rewritten) == 1
    gone = before - set(table.folders)
    assert {(f.year, f.bucket) for f in gone} == set(rewritten)
    assert len(before & set(table.folders)) == len(before) - 1
    same(table, base, again)


def test_new_keys_and_years_rewrite_nothing(make_tickets, table):
    base = make_tickets(*[{"summons_number": i} for i in range(50)])
    table.add(base)
    before = set(table.folders)
    later = make_tickets(*[{"summons_number": i, "file_fy": 2016} for i in range(50)])
    assert table.add(later) == []
    assert before < set(table.folders)
    same(table, base, later)


def test_reads_touch_only_the_buckets_of_the_filters(spark, make_tickets, table):
    table.add(make_tickets(*[{"summons_number": i} for i in range(200)]))
    files = table.tickets().inputFiles()
    assert len(files) >= 8
    table.add(make_tickets({"summons_number": 5, "issue_date": "01/01/2015"}))
    kept = set(files) & set(table.tickets().inputFiles())
    assert len(kept) == len(files) - len([f for f in files if f not in kept])
    assert len(set(files) - kept) <= 2


def test_a_changed_file_takes_the_place_of_its_year(make_tickets, table):
    old = make_tickets(*[{"summons_number": i} for i in range(20)])
    other = make_tickets(*[{"summons_number": i, "file_fy": 2016} for i in range(20)])
    changed = make_tickets(*[{"summons_number": i, "violation_code": 99} for i in range(5)])
    table.add(old)
    table.add(other)
    table.replace_years(changed)
    same(table, changed, other)


def test_a_table_is_found_again(spark, make_tickets, table, tmp_path):
    first, second = make_tickets({"summons_number": 1}), make_tickets({"summons_number": 2})
    table.add(first)
    found = IncrementalTickets(spark, str(tmp_path / "table"))
    found.add(second)
    same(found, first, second)
    assert {f.bucket < 8 for f in found.folders} == {True}


def test_an_empty_file_changes_nothing(make_tickets, table):
    some = make_tickets({"summons_number": 1})
    table.add(some)
    assert table.add(some.limit(0)) == []
    same(table, some)
