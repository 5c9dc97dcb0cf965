"""How far months lie above or below the trend of their time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.functions.calendar import fiscal_year_of
from curbside.operators import fill_days, frequency, with_trend, years_before
from curbside.plans.registry import query
from curbside.schema import FISCAL_YEAR
from curbside.stages import TicketStages

# Days to each side of the one a trend is of: together a year.
HALF_YEAR = 182


@query(f"""
WITH daily AS (
  SELECT violation_code, issue_dt AS day, count(*) AS n FROM clean
  WHERE issue_dt IS NOT NULL GROUP BY violation_code, issue_dt),
spans AS (
  SELECT violation_code, min(day) AS first_day, max(day) AS last_day
  FROM daily GROUP BY violation_code),
calendar AS (
  SELECT violation_code,
         CAST(unnest(generate_series(first_day, last_day, INTERVAL 1 DAY)) AS DATE) AS day
  FROM spans),
filled AS (
  SELECT c.violation_code, c.day, coalesce(d.n, 0) AS n
  FROM calendar c LEFT JOIN daily d
    ON c.day = d.day AND c.violation_code IS NOT DISTINCT FROM d.violation_code),
trends AS (
  SELECT *, 1000 * sum(n) OVER around // count(*) OVER around AS trend
  FROM filled
  WINDOW around AS (PARTITION BY violation_code ORDER BY day
                    RANGE BETWEEN INTERVAL {HALF_YEAR} DAY PRECEDING
                              AND INTERVAL {HALF_YEAR} DAY FOLLOWING)),
months AS (
  SELECT year(day) + CASE WHEN month(day) >= 7 THEN 1 ELSE 0 END AS fy,
         violation_code, month(day) AS m, sum(n) AS tickets, sum(trend) AS trends
  FROM trends GROUP BY fy, violation_code, m),
indexed AS (
  SELECT *, 10000000 * tickets // nullif(trends, 0) AS season_index FROM months)
SELECT CAST(a.fy AS INTEGER) AS file_fy, a.violation_code, CAST(a.m AS INTEGER) AS issue_month,
       CAST(a.tickets AS BIGINT) AS ticket_count, CAST(a.trends AS BIGINT) AS trend,
       CAST(a.season_index AS BIGINT) AS season_index,
       CAST(b.season_index AS BIGINT) AS index_year_before
FROM indexed a LEFT JOIN indexed b
  ON b.fy = a.fy - 1 AND b.m = a.m AND b.violation_code IS NOT DISTINCT FROM a.violation_code
""", on="clean")
def season_index(stages: TicketStages) -> DataFrame:
    """Tickets of each code and month as ten-thousandths of the trend of its days, the
    mean of the year around each, and the same month's index of the year before.

    Tickets are counted by day first; all else is of days. Days without a ticket count
    as such between a code's first and last. A month without a trend has no index.
    """
    tickets = stages.clean("violation_code", "issue_dt")
    daily = frequency(tickets, ["violation_code", "issue_dt"])
    days = fill_days(daily, ["violation_code"], "issue_dt", "ticket_count")
    trends = with_trend(days, ["violation_code"], "issue_dt", "ticket_count", HALF_YEAR)
    month = [FISCAL_YEAR, "violation_code", "issue_month"]
    months = (
        trends.withColumn(FISCAL_YEAR, fiscal_year_of(F.col("issue_dt")).cast("int"))
        .withColumn("issue_month", F.month("issue_dt"))
        .groupBy(*month)
        .agg(F.sum("ticket_count").alias("ticket_count"), F.sum("trend").alias("trend"))
    )
    index = F.when(F.col("trend") > 0, F.expr("10000000 * ticket_count DIV trend"))
    before = years_before("season_index", ["violation_code", "issue_month"], FISCAL_YEAR)
    return months.withColumn("season_index", index).withColumn("index_year_before", before)
