"""Deduplication, the fiscal-year check and what they remove."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.operators import count_and_share, frequency
from curbside.plans.registry import query
from curbside.schema import FISCAL_YEAR, KEY, TICKET_COLUMNS
from curbside.stages import KEYLESS, OUT_OF_RANGE, STATUS, UNDATED, TicketStages

_ALL = ", ".join(TICKET_COLUMNS)

_OUTSIDE = (
    "issue_dt NOT BETWEEN make_date(file_fy - 1, 7, 1) AND make_date(file_fy, 6, 30)"
)


@query(f"SELECT {_ALL} FROM deduplicated", on="deduplicated")
def dedup_tickets(stages: TicketStages) -> DataFrame:
    """One ticket per key and file."""
    return stages.deduplicated()


@query("SELECT file_fy, count(*) AS ticket_count FROM deduplicated GROUP BY file_fy",
       on="deduplicated")
def dedup_ticket_count(stages: TicketStages) -> DataFrame:
    """Tickets left per year after deduplication."""
    return frequency(stages.deduplicated(KEY), [FISCAL_YEAR])


@query("""
SELECT file_fy, CAST(year(issue_dt) AS INTEGER) AS issue_year, count(*) AS ticket_count
FROM deduplicated GROUP BY ALL
""", on="deduplicated")
def issue_year_distribution(stages: TicketStages) -> DataFrame:
    """Calendar years of issue in each file, before the date filter."""
    dated = stages.deduplicated("issue_dt").withColumn("issue_year", F.year("issue_dt"))
    return frequency(dated, [FISCAL_YEAR, "issue_year"]).orderBy(
        FISCAL_YEAR, F.desc("ticket_count"), "issue_year"
    )


def _invalid_dates(stages: TicketStages) -> DataFrame:
    return count_and_share(
        stages.deduplicated(STATUS),
        [FISCAL_YEAR],
        F.col(STATUS) == OUT_OF_RANGE,
        "invalid_date",
    )


@query(f"""
SELECT file_fy, count(*) FILTER (WHERE {_OUTSIDE}) AS invalid_date_count
FROM deduplicated GROUP BY file_fy
""", on="deduplicated")
def invalid_issue_date_count(stages: TicketStages) -> DataFrame:
    """Tickets dated outside their file's fiscal year."""
    return _invalid_dates(stages).select(FISCAL_YEAR, "invalid_date_count")


@query(f"""
SELECT file_fy, count(*) FILTER (WHERE {_OUTSIDE}) AS invalid_date_count,
       count(*) AS ticket_count,
       CAST(count(*) FILTER (WHERE {_OUTSIDE}) AS DOUBLE) / CAST(count(*) AS DOUBLE)
         AS invalid_date_share
FROM deduplicated GROUP BY file_fy
""", on="deduplicated")
def invalid_issue_date_share(stages: TicketStages) -> DataFrame:
    """The part of all tickets such dates make up."""
    return _invalid_dates(stages)


@query("""
SELECT file_fy, count(*) FILTER (WHERE issue_dt IS NULL) AS undated_count,
       count(*) FILTER (WHERE summons_number IS NULL AND issue_dt BETWEEN
                        make_date(file_fy - 1, 7, 1) AND make_date(file_fy, 6, 30))
         AS keyless_count
FROM deduplicated GROUP BY file_fy
""", on="deduplicated")
def set_aside_count(stages: TicketStages) -> DataFrame:
    """Tickets whose date can't be read, and those in range that lack a key: what
    the clean table leaves out beside the tickets dated out of range."""
    return stages.deduplicated(STATUS).groupBy(FISCAL_YEAR).agg(
        F.count_if(F.col(STATUS) == UNDATED).alias("undated_count"),
        F.count_if(F.col(STATUS) == KEYLESS).alias("keyless_count"),
    )


@query(f"SELECT {_ALL} FROM valid", on="valid")
def valid_fiscal_tickets(stages: TicketStages) -> DataFrame:
    """Tickets dated inside their file's fiscal year."""
    return stages.valid()


@query(f"SELECT {_ALL} FROM clean", on="clean")
def clean_tickets(stages: TicketStages) -> DataFrame:
    """Valid tickets with a key, the table the questions are about."""
    return stages.clean()
