"""Fiscal years side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbside.functions.address import address_is_missing
from curbside.plans.examine import NO_ADDRESS_SQL, STATES_SQL, known_states
from curbside.plans.oracle import top_k_sql
from curbside.plans.registry import query
from curbside.schema import ADDRESS_COLUMNS, FISCAL_YEAR
from curbside.stages import TicketStages


@query(f"""
SELECT file_fy, count(*) AS ticket_count, {STATES_SQL} AS state_count,
       {NO_ADDRESS_SQL} AS missing_address_count
FROM clean GROUP BY file_fy
""", on="clean")
def yearly_summary(stages: TicketStages) -> DataFrame:
    """Tickets, states and missing addresses of each year, in one pass."""
    return (
        stages.clean("registration_state", *ADDRESS_COLUMNS)
        .groupBy(FISCAL_YEAR)
        .agg(
            F.count(F.lit(1)).alias("ticket_count"),
            known_states().alias("state_count"),
            F.count_if(address_is_missing()).alias("missing_address_count"),
        )
    )


@query(top_k_sql("clean", ["file_fy"], ["violation_code"], 5, count="count(violation_code)"),
       on="clean")
def union_by_year(stages: TicketStages) -> DataFrame:
    """The most frequent codes of each year, one frame per year put together.

    The same rows as ``top5_violation_code``, in the form to use when years come
    as separate frames: each is cut to five rows by a sorted limit, and the tag
    column says which year a row is of. All frames are taken of one table of
    counts, whose shuffle they share, so the tickets are scanned once however many
    years there are.
    """
    # The year as an aggregate: a filter on the grouping key Spark would push below
    # the counting, and every year would scan the tickets for itself.
    counts = (
        stages.clean("violation_code")
        .groupBy(FISCAL_YEAR, "violation_code")
        .agg(F.count("violation_code").alias("ticket_count"), F.max(FISCAL_YEAR).alias("year"))
    )

    def of_year(year: int) -> DataFrame:
        own = counts.filter(F.col("year") == year)
        top = own.orderBy(F.desc("ticket_count"), "violation_code").limit(5)
        return top.select(F.lit(year).alias(FISCAL_YEAR), "violation_code", "ticket_count")

    if not stages.years:
        return counts.drop("year").withColumn("rank", F.lit(1)).limit(0)
    together = reduce(DataFrame.unionByName, [of_year(y) for y in stages.years])
    ordered = Window.partitionBy(FISCAL_YEAR).orderBy(
        F.desc("ticket_count"), "violation_code"
    )
    return together.withColumn("rank", F.row_number().over(ordered)).select(
        FISCAL_YEAR, "violation_code", "ticket_count", "rank"
    )
