"""What the tables hold before any cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.operators import column_profile, frequency, key_profile, preview
from curbside.plans.registry import query
from curbside.schema import FISCAL_YEAR, KEY, SURVIVOR_ORDER, TICKET_COLUMNS, TICKET_FIELDS
from curbside.stages import TicketStages

PREVIEW_ROWS = 6


@query("SELECT file_fy, count(*) AS ticket_count FROM raw_tickets GROUP BY file_fy",
       on="raw_tickets")
def raw_ticket_count(stages: TicketStages) -> DataFrame:
    """Rows of each year's file."""
    return frequency(stages.raw(KEY), [FISCAL_YEAR])


_PROFILE_SQL = " UNION ALL ".join(
    f"SELECT file_fy, '{name}' AS column_name, '{kind}' AS data_type, "
    f"count({name}) AS non_null_count, count(DISTINCT {name}) AS distinct_count "
    "FROM raw_tickets GROUP BY file_fy"
    for _, name, kind in TICKET_FIELDS
)


@query(_PROFILE_SQL, on="raw_tickets")
def table_profile(stages: TicketStages) -> DataFrame:
    """Columns of each year's file with their type, fill and distinct values."""
    others = [name for name in stages.columns if name != KEY]
    return key_profile(stages.raw(KEY), FISCAL_YEAR, KEY).unionByName(
        column_profile(stages.raw(*others), FISCAL_YEAR)
    )


_PREVIEW_ORDER = ", ".join(
    [f"{KEY} ASC NULLS LAST"] + [f"{c} ASC NULLS FIRST" for c in SURVIVOR_ORDER]
)


@query(f"""
SELECT {", ".join(TICKET_COLUMNS)}
FROM (SELECT *, row_number() OVER (PARTITION BY file_fy ORDER BY {_PREVIEW_ORDER}) AS place
      FROM raw_tickets)
WHERE place <= {PREVIEW_ROWS}
""", on="raw_tickets")
def ticket_preview(stages: TicketStages) -> DataFrame:
    """The first rows of each year's file by key."""
    order = [F.col(c).asc_nulls_first() for c in SURVIVOR_ORDER]
    return preview(stages.raw(), stages.raw(KEY), FISCAL_YEAR, KEY, order, PREVIEW_ROWS)
