"""Fines the most frequent codes bring in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbside.functions.fines import fine_schedule as schedule
from curbside.operators import frequency, top_k
from curbside.plans.oracle import top_k_sql
from curbside.plans.registry import query
from curbside.schema import FISCAL_YEAR
from curbside.stages import TicketStages

_OCCURRENCES_SQL = top_k_sql(
    "clean", ["file_fy"], ["violation_code"], 3, measure="occurrences"
)


def _occurrences(stages: TicketStages) -> DataFrame:
    counted = frequency(
        stages.clean("violation_code"), [FISCAL_YEAR, "violation_code"], "occurrences"
    )
    return top_k(counted, [FISCAL_YEAR], ["violation_code"], 3, "occurrences")


def with_revenue(occurrences: DataFrame) -> DataFrame:
    """Adds the average fine of each code, the fines collected and their rank.

    Takes a few codes per year, as :func:`top_k` gives them. A code without a
    price has no collection and ranks last. The schedule is a fixed handful of
    rows, so it is broadcast.
    """
    prices = schedule(occurrences.sparkSession).select("violation_code", "average_fine")
    priced = occurrences.join(F.broadcast(prices), ["violation_code"], "left").withColumn(
        "total_fines_collected", F.col("occurrences") * F.col("average_fine")
    )
    largest = Window.partitionBy(FISCAL_YEAR).orderBy(
        F.col("total_fines_collected").desc_nulls_last(), "violation_code"
    )
    return priced.withColumn("revenue_rank", F.row_number().over(largest)).select(
        FISCAL_YEAR, "revenue_rank", "violation_code", "occurrences", "average_fine",
        "total_fines_collected",
    )


@query(_OCCURRENCES_SQL, on="clean")
def top3_code_occurrences(stages: TicketStages) -> DataFrame:
    """The three most frequent codes of all clean tickets."""
    return _occurrences(stages).orderBy(FISCAL_YEAR, "rank")


@query("""
WITH counted AS (SELECT file_fy, violation_code, count(*) AS ticket_count
                 FROM clean GROUP BY file_fy, violation_code)
SELECT file_fy, violation_code, fine_high, fine_other, average_fine, ticket_count
FROM counted JOIN priced USING (violation_code)
""", on="priced")
def fine_schedule(stages: TicketStages) -> DataFrame:
    """The fines of the priced codes and the tickets they apply to."""
    counted = frequency(stages.clean("violation_code"), [FISCAL_YEAR, "violation_code"])
    prices = schedule(counted.sparkSession)
    return counted.join(F.broadcast(prices), ["violation_code"]).select(
        FISCAL_YEAR, "violation_code", "fine_high", "fine_other", "average_fine",
        "ticket_count",
    )


_REVENUE_SQL = f"""
WITH top3 AS ({_OCCURRENCES_SQL}),
revenue AS (
  SELECT file_fy, violation_code, occurrences, average_fine,
         occurrences * average_fine AS total_fines_collected
  FROM top3 LEFT JOIN priced USING (violation_code)),
ranked AS (
  SELECT *, CAST(row_number() OVER (
              PARTITION BY file_fy
              ORDER BY total_fines_collected DESC NULLS LAST, violation_code ASC NULLS FIRST
            ) AS INTEGER) AS revenue_rank
  FROM revenue)
"""


@query(_REVENUE_SQL + """
SELECT file_fy, revenue_rank, violation_code, occurrences, average_fine,
       total_fines_collected
FROM ranked
""", on="priced")
def fine_revenue(stages: TicketStages) -> DataFrame:
    """Fines collected for each of those codes, the largest first."""
    return with_revenue(_occurrences(stages)).orderBy(FISCAL_YEAR, "revenue_rank")


@query(_REVENUE_SQL + """
SELECT file_fy, violation_code, total_fines_collected FROM ranked WHERE revenue_rank = 1
""", on="priced")
def top_revenue_code(stages: TicketStages) -> DataFrame:
    """The code with the largest collection of each year."""
    return (
        with_revenue(_occurrences(stages))
        .filter(F.col("revenue_rank") == 1)
        .select(FISCAL_YEAR, "violation_code", "total_fines_collected")
    )
