"""Totals and subtotals of several groupings in one answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.functions import clock
from curbside.operators import marginals
from curbside.plans.registry import query
from curbside.plans.seasons import with_season
from curbside.schema import FISCAL_YEAR
from curbside.stages import TicketStages

COLUMNS = [FISCAL_YEAR, "season", "time_bin", "violation_precinct", "violation_code"]
SETS = [
    [],
    ["file_fy"],
    ["file_fy", "season"],
    ["file_fy", "time_bin"],
    ["file_fy", "violation_precinct"],
    ["file_fy", "violation_code"],
    ["file_fy", "season", "time_bin"],
    ["season", "time_bin"],
    ["violation_precinct"],
    ["violation_code"],
]

_SETS_SQL = ", ".join(f"({', '.join(of)})" for of in SETS)
_COLUMNS_SQL = ", ".join(COLUMNS)


@query(f"""
WITH labelled AS (
  SELECT file_fy, violation_precinct, violation_code,
         CASE WHEN month(issue_dt) IN (3, 4, 5) THEN 'Spring'
              WHEN month(issue_dt) IN (6, 7, 8) THEN 'Summer'
              WHEN month(issue_dt) IN (9, 10, 11) THEN 'Fall' ELSE 'Winter' END AS season,
         CASE WHEN hour > 12 OR am_pm NOT IN ('A', 'P') THEN NULL
              WHEN hour % 12 BETWEEN 0 AND 3 AND am_pm = 'A' THEN 'MidNight'
              WHEN hour % 12 BETWEEN 4 AND 7 AND am_pm = 'A' THEN 'Dawn'
              WHEN hour % 12 BETWEEN 8 AND 11 AND am_pm = 'A' THEN 'Day'
              WHEN hour % 12 BETWEEN 0 AND 3 AND am_pm = 'P' THEN 'Noon'
              WHEN hour % 12 BETWEEN 4 AND 7 AND am_pm = 'P' THEN 'Dusk'
              WHEN hour % 12 BETWEEN 8 AND 11 AND am_pm = 'P' THEN 'Night' END AS time_bin
  FROM parts)
SELECT CAST(GROUPING({_COLUMNS_SQL}) AS BIGINT) AS grouping, {_COLUMNS_SQL},
       count(*) AS ticket_count
FROM labelled GROUP BY GROUPING SETS ({_SETS_SQL})
""", on="parts")
def marginal_counts(stages: TicketStages) -> DataFrame:
    """Clean tickets by year, season, time bin, precinct and code and by sets of them.
    Tickets without a valid time have a null bin, a group unlike the subtotals."""
    tickets = with_season(
        stages.clean("issue_dt", "hour", "am_pm", "violation_precinct", "violation_code")
    )
    hour, meridiem = clock.fold_twelve(F.col("hour")), F.col("am_pm")
    return marginals(tickets.withColumn("time_bin", clock.bin_of(hour, meridiem)), COLUMNS, SETS)
