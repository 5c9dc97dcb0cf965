"""Months and seasons of issue, within each fiscal year.

A fiscal year's Summer is July and August of its first calendar year and June of
its second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.functions.calendar import season_of
from curbside.operators import frequency, top_k
from curbside.plans.oracle import top_k_sql
from curbside.plans.registry import query
from curbside.schema import FISCAL_YEAR
from curbside.stages import TicketStages


def with_month(tickets: DataFrame) -> DataFrame:
    return tickets.withColumn("issue_month", F.month("issue_dt"))


def with_season(tickets: DataFrame) -> DataFrame:
    """Adds ``issue_month`` and ``season`` to tickets with an ``issue_dt``."""
    return with_month(tickets).withColumn("season", season_of(F.col("issue_month")))


_MONTHS = [FISCAL_YEAR, "summons_number", "violation_code", "issue_dt", "issue_month"]
_SEASONS = [*_MONTHS, "season"]


@query(f"SELECT {', '.join(_MONTHS)} FROM months", on="months")
def issue_month(stages: TicketStages) -> DataFrame:
    """Date and month of every clean ticket."""
    return with_month(stages.clean("summons_number", "violation_code", "issue_dt")).select(
        *_MONTHS
    )


@query("SELECT DISTINCT file_fy, issue_month FROM months", on="months")
def distinct_months(stages: TicketStages) -> DataFrame:
    """Months seen in each year, to see the impossible ones."""
    return with_month(stages.clean("issue_dt")).select(FISCAL_YEAR, "issue_month").distinct()


@query(f"SELECT {', '.join(_SEASONS)} FROM seasons", on="seasons")
def season_bins(stages: TicketStages) -> DataFrame:
    """Date, month and season of every clean ticket."""
    return with_season(stages.clean("summons_number", "violation_code", "issue_dt")).select(
        *_SEASONS
    )


@query("SELECT file_fy, season, count(*) AS ticket_count FROM seasons "
       "GROUP BY file_fy, season", on="seasons")
def season_frequency(stages: TicketStages) -> DataFrame:
    """Tickets of each season, the busiest first."""
    return frequency(with_season(stages.clean("issue_dt")), [FISCAL_YEAR, "season"]).orderBy(
        FISCAL_YEAR, F.desc("ticket_count"), "season"
    )


@query(top_k_sql("seasons", ["file_fy", "season"], ["violation_code"], 3), on="seasons")
def top3_codes_by_season(stages: TicketStages) -> DataFrame:
    """The three most frequent codes of each season."""
    per_season = [FISCAL_YEAR, "season"]
    seasonal = with_season(stages.clean("violation_code", "issue_dt"))
    counted = frequency(seasonal, [*per_season, "violation_code"])
    return top_k(counted, per_season, ["violation_code"], 3).orderBy(*per_season, "rank")
