from __future__ import annotations

import os

import pytest
from pyspark.sql import DataFrame, SparkSession

from curbside import TicketStages, shared
from curbside.schema import FISCAL_YEAR, TICKET_FIELDS

DATA = "/root/testdata"

SCHEMA = f"{FISCAL_YEAR} int, " + ", ".join(f"{name} {kind}" for _, name, kind in TICKET_FIELDS)

DEFAULTS = {
    "file_fy": 2015,
    "issue_date": "10/01/2014",
    "registration_state": "NY",
    "violation_code": 21,
    "vehicle_body_type": "SUBN",
    "vehicle_make": "FORD",
    "violation_precinct": 1,
    "issuer_precinct": 1,
    "violation_time": "0953A",
    "house_number": "1",
    "street_name": "MAIN ST",
    "intersecting_street": None,
}


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    session = (
        SparkSession.builder.master("local[8]")
        .appName("curbside-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    with pytest.MonkeyPatch.context() as patch:
        if shared.shared_folder(session) is None:
            own = str(tmp_path_factory.mktemp("shared"))
            patch.setattr(shared, "shared_folder", lambda spark: own)
        yield session
    session.stop()


@pytest.fixture(scope="session")
def make_tickets(spark):
    """Tickets of the given dicts; what a dict lacks is a valid default, and the
    key is the position unless given."""

    def make(*rows: dict) -> DataFrame:
        full = [{"summons_number": i, **DEFAULTS, **row} for i, row in enumerate(rows, 1)]
        columns = [field.split()[0] for field in SCHEMA.split(", ")]
        return spark.createDataFrame([tuple(r[c] for c in columns) for r in full], SCHEMA)

    return make


@pytest.fixture(scope="session")
def make_stages(make_tickets):
    def make(*rows: dict) -> TicketStages:
        tickets = make_tickets(*rows)
        return TicketStages(tickets, sorted({r.get("file_fy", 2015) for r in rows}))

    return make


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")

    def connect(scale: str):
        folder = f"{DATA}/{scale}"
        connection = duckdb.connect()
        for file in os.listdir(folder):
            name = file.removesuffix(".parquet")
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{file}'")
        return connection

    return connect


def rows_of(df: DataFrame, *columns: str) -> list[tuple]:
    return [tuple(r) for r in df.select(*(columns or df.columns)).collect()]
