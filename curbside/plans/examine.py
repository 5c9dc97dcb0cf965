"""Tickets, states and missing addresses of each fiscal year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbside.functions.address import address_is_missing
from curbside.operators import count_and_share, frequency
from curbside.plans.registry import query
from curbside.schema import ADDRESS_COLUMNS, FISCAL_YEAR, UNKNOWN_STATE
from curbside.stages import TicketStages

STATES_SQL = "count(DISTINCT registration_state) FILTER (WHERE registration_state <> '99')"
NO_ADDRESS_SQL = """count(*) FILTER (WHERE house_number IS NULL AND street_name IS NULL
                          AND intersecting_street IS NULL)"""


def known_states() -> Column:
    """Number of distinct states; the sentinel is not one."""
    state = F.col("registration_state")
    return F.count_distinct(F.when(state != UNKNOWN_STATE, state))


@query("SELECT file_fy, count(*) AS ticket_count FROM clean GROUP BY file_fy", on="clean")
def total_tickets(stages: TicketStages) -> DataFrame:
    """Tickets of each fiscal year."""
    return frequency(stages.clean("summons_number"), [FISCAL_YEAR])


@query("SELECT DISTINCT file_fy, registration_state FROM clean", on="clean")
def distinct_states(stages: TicketStages) -> DataFrame:
    """States of registration seen in each year, the sentinel included."""
    return stages.clean("registration_state").distinct()


@query(f"SELECT file_fy, {STATES_SQL} AS state_count FROM clean GROUP BY file_fy",
       on="clean")
def unique_state_count(stages: TicketStages) -> DataFrame:
    """Number of states of registration in each year, without the sentinel."""
    return (
        stages.clean("registration_state")
        .groupBy(FISCAL_YEAR)
        .agg(known_states().alias("state_count"))
    )


@query(f"SELECT file_fy, {NO_ADDRESS_SQL} AS missing_address_count "
       "FROM clean GROUP BY file_fy", on="clean")
def missing_address_count(stages: TicketStages) -> DataFrame:
    """Tickets with no part of an address."""
    counted = count_and_share(
        stages.clean(*ADDRESS_COLUMNS), [FISCAL_YEAR], address_is_missing(), "missing_address"
    )
    return counted.select(FISCAL_YEAR, "missing_address_count")
