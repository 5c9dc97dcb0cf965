"""Ticket files and views."""

from __future__ import annotations

import pytest

from curbside import (
    TicketStages,
    column_counts,
    lost_values,
    read_ticket_csv,
    read_ticket_years,
    register_views,
)
from curbside.plans.frequencies import top5_violation_code
from curbside.schema import KEY, TICKET_COLUMNS
from tests.conftest import SCHEMA, rows_of

HEADER_2015 = (
    "Summons Number,Plate ID,Registration State,Issue Date,Violation Code,"
    "Vehicle Body Type,Vehicle Make,Violation Precinct,Issuer Precinct,Violation Time,"
    "House Number,Street Name,Intersecting Street,Days Parking In Effect    "
)
ROWS_2015 = [
    '1,AB1,NY,10/01/2014,21,SUBN,FORD,1,0,0953A,5,"MAIN, EAST",,YYY',
    "2,AB2,99,06/30/2015,x,4DSD,,1,0,0520P,,,,",
    "oops,AB3,NJ,06/30/2014,14,VAN,HONDA,2,19,,,ELM,,",
]
# Another order of columns and fewer of them.
HEADER_2016 = (
    "Issue Date,Summons Number,Registration State,Violation Code,Vehicle Body Type,"
    "Vehicle Make,Violation Precinct,Issuer Precinct,Violation Time,House Number,"
    "Street Name,Intersecting Street"
)
ROWS_2016 = ["12/01/2015,9,NY,38,SUBN,BMW,3,3,1200A,1,OAK,"]


@pytest.fixture
def files(tmp_path):
    paths = {}
    for year, header, rows in (
        (2015, HEADER_2015, ROWS_2015), (2016, HEADER_2016, ROWS_2016),
    ):
        path = tmp_path / f"fiscal_year_{year}.csv"
        path.write_text("\n".join([header, *rows]) + "\n")
        paths[year] = str(path)
    return paths


def test_columns_are_found_by_header_and_typed(spark, files):
    tickets = read_ticket_years(spark, files)
    assert tickets.columns == TICKET_COLUMNS
    assert tickets.dtypes == [tuple(field.split()) for field in SCHEMA.split(", ")]
    by_key = {r.summons_number: r for r in tickets.collect()}
    assert len(by_key) == 4 and by_key.keys() >= {1, 2, 9}
    assert min(by_key) < 0
    assert by_key[1].street_name == "MAIN, EAST"
    assert by_key[2].violation_code is None and by_key[2].vehicle_make is None
    assert (by_key[9].file_fy, by_key[9].issue_date) == (2016, "12/01/2015")


def test_other_columns_can_be_kept(spark, files):
    tickets = read_ticket_years(spark, files, other_columns=True)
    assert tickets.columns == [*TICKET_COLUMNS, "plate_id", "days_parking_in_effect"]
    plates = dict(rows_of(TicketStages(tickets, (2015, 2016)).clean(KEY, "plate_id"), KEY, "plate_id"))
    assert {k: v for k, v in plates.items() if k > 0} == {1: "AB1", 2: "AB2", 9: None}


def test_unreadable_keys_stay_different_tickets(spark, tmp_path):
    path = tmp_path / "keys.csv"
    rows = [ROWS_2015[2].replace("oops", key).replace("06/30/2014", "10/01/2014")
            for key in ("A1", "A2", "A2", "", "7")]
    path.write_text("\n".join([HEADER_2015, *rows]) + "\n")
    stages = TicketStages(read_ticket_csv(spark, str(path), 2015), (2015,))
    assert stages.deduplicated().count() == 4
    assert stages.clean().count() == 3


def test_lost_values_and_columns_are_counted(spark, files):
    lost = {tuple(r) for r in lost_values(spark, files).collect() if r.lost_count}
    assert lost == {(2015, "summons_number", 1), (2015, "violation_code", 1)}
    assert sorted(rows_of(column_counts(spark, files))) == [(2015, 14), (2016, 12)]


def test_two_headers_of_one_name(spark, tmp_path):
    path = tmp_path / "twice.csv"
    path.write_text(f"{HEADER_2015.strip()},Issue_Date\n{ROWS_2015[0]},01/01/2000\n")
    with pytest.raises(ValueError, match="issue_date"):
        read_ticket_csv(spark, str(path), 2015)
    path.write_text(f"{HEADER_2015.strip()},Plate_ID\n{ROWS_2015[0]},XY\n")
    tickets = read_ticket_csv(spark, str(path), 2015, other_columns=True)
    assert rows_of(tickets, "plate_id", "plate_id_2") == [("AB1", "XY")]


def test_line_breaks_in_quotes(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text(f"{HEADER_2015}\n" + ROWS_2015[0].replace("MAIN, EAST", "MAIN\nEAST") + "\n")
    tickets = read_ticket_csv(spark, str(path), 2015, multi_line=True)
    assert rows_of(tickets, "street_name") == [("MAIN\nEAST",)]


def test_a_file_without_a_needed_column_is_refused(spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_text("Summons Number,Issue Date\n1,10/01/2014\n")
    with pytest.raises(ValueError, match="violation_code"):
        read_ticket_csv(spark, str(path), 2015)


def test_only_used_columns_are_parsed(spark, files):
    stages = TicketStages(read_ticket_years(spark, files), (2015, 2016))
    plan = top5_violation_code(stages)._jdf.queryExecution().executedPlan().toString()
    schemas = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert schemas and all("Vehicle Make" not in line for line in schemas)
    assert all("Violation Code" in line for line in schemas)


def test_views_answer_sql(spark, files):
    stages = TicketStages(read_ticket_years(spark, files), (2015, 2016))
    names = register_views(stages)
    assert {v.name for v in spark.catalog.listTables()} >= set(names)
    count = "SELECT count(*) FROM "
    counts = {n: spark.sql(count + n).first()[0] for n in names}
    assert counts == {
        "raw_tickets": 4, "deduplicated_tickets": 4, "valid_tickets": 3,
        "clean_tickets": 3, "timed_tickets": 3, "seasonal_tickets": 3,
    }
    top = spark.sql(
        "SELECT time_bin, count(*) AS n FROM timed_tickets WHERE file_fy = 2015 "
        "GROUP BY time_bin ORDER BY count(*) DESC, time_bin LIMIT 3"
    )
    assert rows_of(top) == [("Day", 1), ("Dusk", 1)]
