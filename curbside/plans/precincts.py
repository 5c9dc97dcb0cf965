"""Violation codes in the precincts that issue the most tickets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.operators import frequency, join_small, nested_top_k
from curbside.plans.frequencies import top_values
from curbside.plans.oracle import top_k_sql
from curbside.plans.registry import query
from curbside.schema import FISCAL_YEAR
from curbside.stages import TicketStages

PRECINCTS = 3
CODES = 10

_TOP3_SQL = top_k_sql(
    "clean", ["file_fy"], ["issuer_precinct"], PRECINCTS, count="count(issuer_precinct)"
)


@query(_TOP3_SQL, on="clean")
def top3_issuer_precincts(stages: TicketStages) -> DataFrame:
    """The precincts that issued the most tickets in each year."""
    return top_values(stages.clean("issuer_precinct"), "issuer_precinct", PRECINCTS)


_ROWS = ["summons_number", "issuer_precinct", "violation_code"]


@query(f"""
WITH top3 AS ({_TOP3_SQL})
SELECT file_fy, {", ".join(_ROWS)}
FROM clean SEMI JOIN top3 USING (file_fy, issuer_precinct)
""", on="clean")
def tickets_in_top_precincts(stages: TicketStages) -> DataFrame:
    """The tickets of those precincts. The broadcast list has three rows a year."""
    top3 = top_values(stages.clean("issuer_precinct"), "issuer_precinct", PRECINCTS)
    return stages.clean(*_ROWS).join(
        F.broadcast(top3), [FISCAL_YEAR, "issuer_precinct"], "left_semi"
    )


def codes_by_precinct(tickets: DataFrame) -> DataFrame:
    """Tickets of each precinct and code, the cells all tables here are made of."""
    return frequency(tickets, [FISCAL_YEAR, "issuer_precinct", "violation_code"])


def top_codes_of_top_precincts(cells: DataFrame) -> DataFrame:
    return nested_top_k(
        cells, FISCAL_YEAR, "issuer_precinct", "violation_code", PRECINCTS, CODES,
        count_nulls=False,
    )


def _cells(stages: TicketStages) -> DataFrame:
    return codes_by_precinct(stages.clean("issuer_precinct", "violation_code"))


_TOP10_SQL = f"""
WITH top3 AS ({_TOP3_SQL}),
coded AS (
  SELECT file_fy, issuer_precinct, violation_code, count(violation_code) AS ticket_count
  FROM clean SEMI JOIN top3 USING (file_fy, issuer_precinct)
  GROUP BY file_fy, issuer_precinct, violation_code),
top10 AS (
  SELECT c.*, t.rank AS precinct_rank, t.ticket_count AS precinct_count,
         CAST(row_number() OVER (
           PARTITION BY file_fy, issuer_precinct
           ORDER BY c.ticket_count DESC, violation_code ASC NULLS FIRST) AS INTEGER) AS rank
  FROM coded c JOIN top3 t USING (file_fy, issuer_precinct)
  QUALIFY row_number() OVER (
    PARTITION BY file_fy, issuer_precinct
    ORDER BY c.ticket_count DESC, violation_code ASC NULLS FIRST) <= {CODES})
"""


@query(_TOP10_SQL + """
SELECT file_fy, precinct_rank, issuer_precinct, rank, violation_code, ticket_count
FROM top10
""", on="clean")
def top10_codes_by_precinct(stages: TicketStages) -> DataFrame:
    """The ten most frequent codes of each of those precincts."""
    return (
        top_codes_of_top_precincts(_cells(stages))
        .withColumnRenamed("group_rank", "precinct_rank")
        .select(
            FISCAL_YEAR, "precinct_rank", "issuer_precinct", "rank", "violation_code",
            "ticket_count",
        )
        .orderBy(FISCAL_YEAR, "precinct_rank", "rank")
    )


def codes_in_all(lists: DataFrame, precincts: int = PRECINCTS) -> DataFrame:
    """Codes that stand in the lists of that many precincts of a year."""
    return (
        lists.groupBy(FISCAL_YEAR, "violation_code")
        .agg(F.count_distinct("issuer_precinct").alias("precinct_count"))
        .filter(F.col("precinct_count") == precincts)
        .select(FISCAL_YEAR, "violation_code")
    )


@query(_TOP10_SQL + f"""
SELECT file_fy, violation_code FROM top10
GROUP BY file_fy, violation_code HAVING count(DISTINCT issuer_precinct) = {PRECINCTS}
""", on="clean")
def common_codes_across_precincts(stages: TicketStages) -> DataFrame:
    """Codes among the ten most frequent in all three precincts."""
    return codes_in_all(top_codes_of_top_precincts(_cells(stages))).orderBy(
        FISCAL_YEAR, "violation_code"
    )


@query(_TOP10_SQL + """,
code_year AS (SELECT file_fy, violation_code, count(*) AS n FROM clean
              GROUP BY file_fy, violation_code),
whole_year AS (SELECT file_fy, count(*) AS n FROM clean GROUP BY file_fy)
SELECT file_fy, issuer_precinct, violation_code, ticket_count,
       CAST(ticket_count AS DOUBLE) / CAST(precinct_count AS DOUBLE) AS precinct_share,
       CAST(c.n AS DOUBLE) / CAST(w.n AS DOUBLE) AS year_share,
       (CAST(ticket_count AS DOUBLE) / CAST(precinct_count AS DOUBLE))
         / (CAST(c.n AS DOUBLE) / CAST(w.n AS DOUBLE)) AS concentration
FROM top10 JOIN code_year c USING (file_fy, violation_code)
           JOIN whole_year w USING (file_fy)
""", on="clean")
def code_concentration(stages: TicketStages) -> DataFrame:
    """How much more frequent a code is in a precinct than in the whole year.

    Every count is summed from the same cells. The list is the broadcast side:
    ten codes of three precincts a year, and the totals are one row a year.
    """
    cells = _cells(stages)
    listed = top_codes_of_top_precincts(cells)
    of_code = cells.groupBy(FISCAL_YEAR, "violation_code").agg(
        F.sum("ticket_count").alias("code_count")
    )
    of_year = cells.groupBy(FISCAL_YEAR).agg(F.sum("ticket_count").alias("year_count"))
    parts = join_small(
        join_small(of_code, listed, [FISCAL_YEAR, "violation_code"]), of_year, [FISCAL_YEAR]
    )

    def ratio(part: str, whole: str):
        return F.col(part).cast("double") / F.col(whole).cast("double")

    return parts.select(
        FISCAL_YEAR, "issuer_precinct", "violation_code", "ticket_count",
        ratio("ticket_count", "group_count").alias("precinct_share"),
        ratio("code_count", "year_count").alias("year_share"),
    ).withColumn("concentration", F.col("precinct_share") / F.col("year_share"))
