"""Names, types and orders every module agrees on."""

from __future__ import annotations

FISCAL_YEAR = "file_fy"
KEY = "summons_number"
# Month and day of one digit or two.
ISSUE_DATE_FORMAT = "M/d/yyyy"
UNKNOWN_STATE = "99"

# Header in a ticket file, column name, Spark type.
TICKET_FIELDS = [
    ("Summons Number", "summons_number", "bigint"),
    ("Issue Date", "issue_date", "string"),
    ("Registration State", "registration_state", "string"),
    ("Violation Code", "violation_code", "int"),
    ("Vehicle Body Type", "vehicle_body_type", "string"),
    ("Vehicle Make", "vehicle_make", "string"),
    ("Violation Precinct", "violation_precinct", "int"),
    ("Issuer Precinct", "issuer_precinct", "int"),
    ("Violation Time", "violation_time", "string"),
    ("House Number", "house_number", "string"),
    ("Street Name", "street_name", "string"),
    ("Intersecting Street", "intersecting_street", "string"),
]

TICKET_COLUMNS = [FISCAL_YEAR] + [name for _, name, _ in TICKET_FIELDS]

ADDRESS_COLUMNS = ["house_number", "street_name", "intersecting_street"]

# Of several rows with one key, the first in this order survives (every column
# ascending, nulls first). Any other column of a source follows these.
SURVIVOR_ORDER = [
    "issue_date",
    "violation_code",
    "violation_time",
    "registration_state",
    "vehicle_body_type",
    "vehicle_make",
    "issuer_precinct",
    "violation_precinct",
    "house_number",
    "street_name",
    "intersecting_street",
]
