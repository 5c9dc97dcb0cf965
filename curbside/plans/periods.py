"""Revenue of fines that change within the year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.functions.fines import DENSE_UP_TO, RISE, area_of, fine_periods
from curbside.operators import interval_join
from curbside.plans.registry import query
from curbside.schema import FISCAL_YEAR
from curbside.stages import TicketStages


@query(f"""
WITH areas AS (
  SELECT violation_code, unnest(['high', 'other']) AS area,
         unnest([fine_high, fine_other]) AS fine
  FROM priced),
tickets AS (
  SELECT file_fy, violation_code, issue_dt,
         CASE WHEN issuer_precinct <= {DENSE_UP_TO} THEN 'high'
              WHEN issuer_precinct > {DENSE_UP_TO} THEN 'other' END AS area
  FROM clean),
dated AS (
  SELECT t.file_fy, t.violation_code, t.area, a.fine,
         CASE WHEN month(issue_dt) >= 7 THEN make_date(year(issue_dt), 7, 1)
              ELSE make_date(year(issue_dt), 1, 1) END AS valid_from
  FROM tickets t JOIN areas a USING (violation_code, area))
SELECT file_fy, violation_code, area, valid_from,
       CAST(any_value(fine) + CASE WHEN month(valid_from) = 1 THEN {RISE} ELSE 0 END AS INTEGER)
         AS fine,
       count(*) AS ticket_count,
       CAST(count(*) * any_value(fine + CASE WHEN month(valid_from) = 1 THEN {RISE} ELSE 0 END)
            AS BIGINT) AS total_fines_collected
FROM dated GROUP BY file_fy, violation_code, area, valid_from
""", on="priced")
def revenue_by_period(stages: TicketStages) -> DataFrame:
    """Fines collected by code, area and the period a fine was valid in.

    Tickets are counted by day before they meet the periods, so the join is of a few
    rows a day, code and precinct area however many tickets there are.
    """
    tickets = stages.clean("violation_code", "issuer_precinct", "issue_dt")
    by_day = (
        tickets.withColumn("area", area_of(F.col("issuer_precinct")))
        .groupBy(FISCAL_YEAR, "violation_code", "area", "issue_dt")
        .agg(F.count(F.lit(1)).alias("day_count"))
    )
    years = stages.years
    periods = fine_periods(tickets.sparkSession, years)
    span = (f"{min(years, default=2) - 1}-07-01", f"{max(years, default=2)}-06-30")
    priced = interval_join(
        by_day, periods, ["violation_code", "area"], "issue_dt", "valid_from", "valid_to",
        days=184, span=span,
    )
    count = F.sum("day_count")
    return priced.groupBy(FISCAL_YEAR, "violation_code", "area", "valid_from", "fine").agg(
        count.alias("ticket_count"), (count * F.col("fine")).alias("total_fines_collected")
    )
