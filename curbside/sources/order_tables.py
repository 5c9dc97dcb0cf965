"""Tickets made of the order tables.

No ticket files are at hand where the queries are checked. This source derives
tickets from ``lineitem`` and its dimensions, one per line, and gives them every
fault the cleaning steps deal with: repeated and null keys, dates outside the
file's fiscal year, of one digit, unreadable or missing, unreadable times, an
unknown state, null makes and missing addresses.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.schema import FISCAL_YEAR, TICKET_COLUMNS, UNKNOWN_STATE

LARGEST_TABLE = "lineitem"
SOURCE_TABLES = ("lineitem", "part", "supplier", "nation")

# File of the lines without a ship date.
UNDATED_FILE = 1900


def _every(number: Column, step: int) -> Column:
    return number % step == 0


def _two_digits(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def _file_year(order: Column, shipped: Column) -> Column:
    """The fiscal year of the date, but the next one for some orders."""
    year = F.year(shipped) + F.when(F.month(shipped) >= 7, 1).otherwise(0)
    misfiled = F.when(_every(order, 37), year + 1).otherwise(year)
    return F.coalesce(misfiled, F.lit(UNDATED_FILE)).cast("int")


def _date(order: Column, line: Column, shipped: Column) -> Column:
    """The date as text, for some lines unreadable, missing or without zeros."""
    return (
        F.when(_every(order, 127) & (line == 1), F.lit(None))
        .when(_every(order, 131), "13/45/2015")
        .when(_every(order, 137), "unknown")
        .when(_every(order, 5), F.date_format(shipped, "M/d/yyyy"))
        .otherwise(F.date_format(shipped, "MM/dd/yyyy"))
    )


def _code(mix: Column) -> Column:
    spot = mix % 100
    return (
        F.when(spot < 14, 21)
        .when(spot < 26, 38)
        .when(spot < 36, 36)
        .when(spot < 45, 14)
        .otherwise(mix % 99 + 1)
        .cast("int")
    )


def _time(order: Column, minute: Column, mix: Column) -> Column:
    hour = F.floor(minute % 720 / 60)
    shown = F.when((hour == 0) & _every(mix, 2), 12).otherwise(hour)
    half = F.when(minute < 720, "A").otherwise("P")
    return (
        F.when(_every(order, 101), F.lit(None))
        .when(_every(order, 103), "0953")
        .when(_every(order, 107), "2553A")
        .when(_every(order, 109), "A953A")
        .when(_every(order, 113), "10230")
        .otherwise(F.concat(_two_digits(shown), _two_digits(minute % 60), half))
    )


# Dimension: its key, the key it is joined by, and the ticket columns made of it.
# The nation's key is the supplier's, so the supplier comes before it.
_DIMENSIONS = {
    "part": ("p_partkey", "l_partkey", {"vehicle_body_type", "vehicle_make"}),
    "supplier": ("s_suppkey", "l_suppkey", {"registration_state", "issuer_precinct"}),
    "nation": ("n_nationkey", "s_nationkey", {"registration_state"}),
}


def order_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in SOURCE_TABLES}


def tickets_from_order_tables(spark: SparkSession, folder: str) -> DataFrame:
    """All columns of the tickets the order tables in ``folder`` make."""
    return tickets_of(order_tables(spark, folder))


def tickets_of(
    tables: Mapping[str, DataFrame], columns: Collection[str] = TICKET_COLUMNS
) -> DataFrame:
    """The tickets the order tables make, before any cleaning.

    Only the dimensions that ``columns`` are made of are joined, so a question
    about codes or times reads ``lineitem`` alone. A line whose part, supplier or
    nation is absent is a ticket with nulls.

    No join is hinted: parts and suppliers grow with the lines, so Spark decides
    by their size whether to broadcast them, and splits skewed keys if it does
    not. Lines are joined with one plain table after another, since only those
    have a size known beforehand.
    """
    lines = tables[LARGEST_TABLE]
    for name, (key, by, made) in _DIMENSIONS.items():
        if made & set(columns):
            lines = lines.join(tables[name], F.col(by) == F.col(key), "left")

    shipped = F.col("l_shipdate")
    order, line, part = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    mix = order * 31 + line * 17 + part
    minute = (order * 7 + part * 3 + line) % 1440
    made = {
        FISCAL_YEAR: _file_year(order, shipped),
        "summons_number": F.when(_every(order, 211) & (line == 1), F.lit(None)).otherwise(
            order * 10 + line
        ),
        "issue_date": _date(order, line, shipped),
        "registration_state": F.when(_every(mix, 53), UNKNOWN_STATE).otherwise(F.col("n_name")),
        "violation_code": _code(mix),
        "vehicle_body_type": F.col("p_type"),
        "vehicle_make": F.when(~_every(mix, 61), F.col("p_brand")),
        "violation_precinct": F.when(_every(mix, 7), 0)
        .otherwise(F.col("l_suppkey") % 25)
        .cast("int"),
        "issuer_precinct": F.when(_every(mix, 6), 0).otherwise(F.col("s_nationkey")).cast("int"),
        "violation_time": _time(order, minute, mix),
        "house_number": F.when(~_every(mix, 5), (mix % 400).cast("string")),
        "street_name": F.when(~_every(mix, 10), "ST"),
        "intersecting_street": F.when(mix % 20 >= 15, "X"),
    }
    return lines.select(*[made[name].alias(name) for name in columns])
