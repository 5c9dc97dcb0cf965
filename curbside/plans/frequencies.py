"""The five most frequent values of a column in each fiscal year."""

from __future__ import annotations

from pyspark.sql import DataFrame

from curbside.operators import frequency, top_k
from curbside.plans.oracle import top_k_sql
from curbside.plans.registry import query
from curbside.schema import FISCAL_YEAR
from curbside.stages import TicketStages


def top_values(tickets: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` values found on most tickets of each year. The null group counts
    0, since it is the column's values that are counted."""
    counted = frequency(tickets, [FISCAL_YEAR, column], count_of=column)
    return top_k(counted, [FISCAL_YEAR], [column], k).orderBy(FISCAL_YEAR, "rank")


def _sql(column: str, k: int = 5) -> str:
    return top_k_sql("clean", ["file_fy"], [column], k, count=f"count({column})")


@query(_sql("violation_code"), on="clean")
def top5_violation_code(stages: TicketStages) -> DataFrame:
    return top_values(stages.clean("violation_code"), "violation_code", 5)


@query(_sql("vehicle_body_type"), on="clean")
def top5_body_type(stages: TicketStages) -> DataFrame:
    return top_values(stages.clean("vehicle_body_type"), "vehicle_body_type", 5)


@query(_sql("vehicle_make"), on="clean")
def top5_vehicle_make(stages: TicketStages) -> DataFrame:
    return top_values(stages.clean("vehicle_make"), "vehicle_make", 5)


@query(_sql("violation_precinct"), on="clean")
def top5_violation_precinct(stages: TicketStages) -> DataFrame:
    return top_values(stages.clean("violation_precinct"), "violation_precinct", 5)


@query(_sql("issuer_precinct"), on="clean")
def top5_issuer_precinct(stages: TicketStages) -> DataFrame:
    return top_values(stages.clean("issuer_precinct"), "issuer_precinct", 5)
