"""Yearly ticket files in CSV, on any path Spark can read."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.schema import FISCAL_YEAR, KEY, TICKET_FIELDS


def _snake_case(header: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", header.strip().lower()).strip("_")


def _columns_of(text: DataFrame, path: str) -> dict[str, str]:
    """Column name: header. Of headers that become one name the ticket columns must
    be sure; others are numbered."""
    names: dict[str, str] = {}
    known = {name for _, name, _ in TICKET_FIELDS}
    for header in text.columns:
        name = _snake_case(header)
        if name in names and name in known:
            raise ValueError(f"{path} has two columns for {name}: {names[name]!r}, {header!r}")
        number, free = 2, name
        while free in names:
            free = f"{name}_{number}"
            number += 1
        names[free] = header
    absent = [name for _, name, _ in TICKET_FIELDS if name not in names]
    if absent:
        raise ValueError(f"{path} lacks the columns {', '.join(absent)}")
    return names


def _text_of(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return spark.read.csv(
        path, header=True, enforceSchema=False, mode="PERMISSIVE", multiLine=multi_line
    )


def _column(header: str) -> Column:
    return F.col("`" + header.replace("`", "``") + "`")


def _typed(text: Column, name: str, kind: str) -> Column:
    """The text as its type, null where it can't be read. A key that can't be read
    stays a key: a negative number made of its text, so that different ones remain
    different tickets."""
    value = text.try_cast(kind)
    if name == KEY:
        stand_in = -1 - F.xxhash64(text).bitwiseAND(F.lit(2**62 - 1))
        value = F.when(value.isNull() & (F.trim(text) != ""), stand_in).otherwise(value)
    return value.alias(name)


def read_ticket_csv(
    spark: SparkSession,
    path: str,
    fiscal_year: int,
    other_columns: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """Tickets of one fiscal year's file or folder of files.

    Columns are found by header, so files may order them differently and carry
    others. Reading the header line is the only work done here: every field is
    text to the parser and ``try_cast`` gives it its type, which spares the pass
    that would infer types and turns unreadable numbers into null;
    :func:`lost_values` counts those. Spark parses only the columns a query uses.
    ``other_columns`` keeps the rest, as text. ``multi_line`` reads fields with
    line breaks in quotes, at the price that a file is then one task.
    """
    text = _text_of(spark, path, multi_line)
    headers = _columns_of(text, path)
    known = [(name, kind) for _, name, kind in TICKET_FIELDS]
    fields = [_typed(_column(headers[name]), name, kind) for name, kind in known]
    if other_columns:
        names = {name for name, _ in known}
        fields += [_column(h).alias(name) for name, h in headers.items() if name not in names]
    return text.select(F.lit(fiscal_year).cast("int").alias(FISCAL_YEAR), *fields)


def lost_values(spark: SparkSession, paths: Mapping[int, str]) -> DataFrame:
    """``file_fy``, ``column_name`` and ``lost_count``: values of each file that are
    there but are not of their column's type."""

    def of_year(year: int, path: str) -> DataFrame:
        text = _text_of(spark, path)
        headers = _columns_of(text, path)
        lost = {
            name: F.count_if(
                (F.trim(_column(headers[name])) != "") & _column(headers[name]).try_cast(kind).isNull()
            )
            for _, name, kind in TICKET_FIELDS
            if kind != "string"
        }
        counts = text.agg(*[count.alias(name) for name, count in lost.items()])
        return counts.unpivot([], list(lost), "column_name", "lost_count").select(
            F.lit(year).cast("int").alias(FISCAL_YEAR), "column_name", "lost_count"
        )

    return reduce(DataFrame.unionByName, [of_year(y, p) for y, p in paths.items()])


def column_counts(spark: SparkSession, paths: Mapping[int, str]) -> DataFrame:
    """``file_fy`` and ``column_count``, the columns each file itself has, of its
    header line alone."""
    rows = [(year, len(_text_of(spark, path).columns)) for year, path in paths.items()]
    return spark.createDataFrame(rows, f"{FISCAL_YEAR} int, column_count int")


def read_ticket_years(
    spark: SparkSession, paths: Mapping[int, str], other_columns: bool = False
) -> DataFrame:
    """Tickets of several fiscal years in one table, tagged ``file_fy``.

    Years may differ in their other columns; what a year lacks is null there.
    """
    years = [
        read_ticket_csv(spark, path, year, other_columns) for year, path in paths.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), years)
