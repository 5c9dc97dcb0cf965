"""Frequent values from stored sketches and quantiles, both exact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.operators import exact_quantiles, frequency, merge_states, sketch_states, sketched_top_k
from curbside.plans.registry import query
from curbside.schema import FISCAL_YEAR
from curbside.shared import own_folder, stored
from curbside.stages import TicketStages

SKETCHED = ["violation_code", "vehicle_make", "vehicle_body_type", "house_number"]
# Values a state lists; house numbers and body types have more.
TRACKED = 96
PERCENTS = [10, 25, 50, 75, 90]


_VALUES_SQL = " UNION ALL ".join(
    f"SELECT file_fy, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM clean"
    for c in SKETCHED
)


@query(f"""
WITH counted AS (
  SELECT file_fy, column_name, value, count(*) AS ticket_count
  FROM ({_VALUES_SQL}) WHERE value IS NOT NULL GROUP BY file_fy, column_name, value),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY file_fy, column_name
                               ORDER BY ticket_count DESC, value) AS place,
         sum(ticket_count) OVER (PARTITION BY file_fy, column_name) AS total
  FROM counted)
SELECT file_fy, column_name, value, ticket_count, CAST(place AS INTEGER) AS rank,
       CAST(total AS BIGINT) AS n
FROM ranked WHERE place <= 5
""", on="clean")
def top5_from_sketches(stages: TicketStages) -> DataFrame:
    """The five most frequent codes, makes, body types and house numbers of each year.

    Months are sketched and stored; the years are merged from them, as they would be
    when a month is added, and a second pass makes the counts exact.
    """
    tickets = stages.clean(*SKETCHED, "issue_dt")
    monthly = sketch_states(
        tickets.withColumn("month", F.trunc("issue_dt", "month")),
        [FISCAL_YEAR, "month"], SKETCHED, TRACKED,
    )
    folder = own_folder(tickets.sparkSession, "sketches")
    monthly.write.parquet(folder)
    stored = tickets.sparkSession.read.schema(monthly.schema).parquet(folder)
    yearly = merge_states(stored, [FISCAL_YEAR], SKETCHED, TRACKED)
    return sketched_top_k(tickets, yearly, [FISCAL_YEAR], SKETCHED, 5, TRACKED)


@query(f"""
WITH placed AS (
  SELECT file_fy, violation_code, issue_dt,
         row_number() OVER (PARTITION BY file_fy, violation_code ORDER BY issue_dt) AS place,
         count(*) OVER (PARTITION BY file_fy, violation_code) AS size
  FROM clean)
SELECT file_fy, violation_code, percent, issue_dt AS issued_by
FROM placed JOIN (SELECT unnest({PERCENTS}) AS percent) ON place = greatest((size * percent + 99) // 100, 1)
""", on="clean")
def issue_date_quantiles(stages: TicketStages) -> DataFrame:
    """The dates by which a tenth, quarter, half and so on of a year's tickets of each
    code had been issued. Every pass is over the counts of days, made once."""
    tickets = stages.clean("violation_code", "issue_dt")
    folder = own_folder(tickets.sparkSession, "quantiles")
    counted = frequency(tickets, [FISCAL_YEAR, "violation_code", "issue_dt"])
    found = exact_quantiles(
        stored(counted, f"{folder}/days"), [FISCAL_YEAR, "violation_code"], "issue_dt",
        PERCENTS, folder, weight="ticket_count",
    )
    return found.withColumnRenamed("value", "issued_by")
