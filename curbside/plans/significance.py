"""Codes that a precinct issues more or less often than chance explains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.operators import (
    ERFC_FIT,
    join_by_size,
    likelihood_ratio,
    log_p_of_ratio,
    step_up,
)
from curbside.plans.precincts import codes_by_precinct
from curbside.plans.registry import query
from curbside.schema import FISCAL_YEAR
from curbside.shared import own_folder, stored
from curbside.stages import TicketStages

RATE = 0.05
# Evidence is G in millionths, so that equal cells tie.
UNIT = 1_000_000


def _term(seen: str, row: str, column: str) -> str:
    return f"CASE WHEN {seen} > 0 THEN {seen} * ln({seen} * n / (({row}) * ({column}))) ELSE 0 END"


def _fit(terms: tuple[float, ...]) -> str:
    head = f"CAST({terms[0]} AS DOUBLE)"
    return head if len(terms) == 1 else f"({head} + t * {_fit(terms[1:])})"


@query(f"""
WITH cells AS (
  SELECT file_fy, issuer_precinct, violation_code, count(*) AS ticket_count
  FROM clean GROUP BY file_fy, issuer_precinct, violation_code),
tables AS (
  SELECT *, CAST(ticket_count AS DOUBLE) AS a,
         CAST(sum(ticket_count) OVER (PARTITION BY file_fy, issuer_precinct) AS DOUBLE) AS r,
         CAST(sum(ticket_count) OVER (PARTITION BY file_fy, violation_code) AS DOUBLE) AS c,
         CAST(sum(ticket_count) OVER (PARTITION BY file_fy) AS DOUBLE) AS n
  FROM cells),
tested AS (
  SELECT *, CAST(round({UNIT} * greatest(0, 2 * (
      {_term("a", "r", "c")} + {_term("(r - a)", "r", "n - c")}
      + {_term("(c - a)", "n - r", "c")} + {_term("(n - r - c + a)", "n - r", "n - c")}
    ))) AS BIGINT) AS evidence
  FROM tables),
chances AS (
  SELECT *, 1 / (1 + 0.5 * sqrt(evidence / CAST({UNIT} AS DOUBLE) / 2)) AS t,
         count(*) OVER (PARTITION BY file_fy ORDER BY evidence DESC) AS rank,
         count(*) OVER (PARTITION BY file_fy) AS tests
  FROM tested),
weakest AS (
  SELECT file_fy, min(evidence) AS least FROM chances
  WHERE ln(t) - evidence / CAST({UNIT} AS DOUBLE) / 2 + {_fit(ERFC_FIT)} <= ln({RATE} * rank / tests)
  GROUP BY file_fy)
SELECT file_fy, issuer_precinct, violation_code, ticket_count, a * n > r * c AS above, evidence,
       rank, coalesce(evidence >= least, false) AS rejected
FROM chances LEFT JOIN weakest USING (file_fy)
""", on="clean")
def significant_codes(stages: TicketStages) -> DataFrame:
    """G-test of every code that occurs in a precinct against the rest of its year, and
    which remain when a twentieth of those reported may be chance.

    ``above`` tells more tickets than expected from fewer. Null precincts and codes are
    groups like others. Everything is of cells, which are counted once.
    """
    counted = codes_by_precinct(stages.clean("issuer_precinct", "violation_code"))
    folder = own_folder(counted.sparkSession, "significance")
    cells = stored(counted, f"{folder}/cells")
    tables = cells
    for of, name in (("issuer_precinct", "row"), ("violation_code", "column"), (None, "all")):
        by = [FISCAL_YEAR, *([of] if of else [])]
        totals = cells.groupBy(*by).agg(F.sum("ticket_count").alias(name))
        tables = join_by_size(tables, totals, by)
    ratio = likelihood_ratio(*(F.col(c) for c in ("ticket_count", "row", "column", "all")))
    share = F.col("ticket_count").cast("double") * F.col("all")
    tested = tables.select(
        *cells.columns, (share > F.col("row").cast("double") * F.col("column")).alias("above"),
        F.round(UNIT * F.greatest(F.lit(0.0), ratio)).cast("bigint").alias("evidence"),
    )
    return step_up(
        tested, [FISCAL_YEAR], "evidence", lambda e: log_p_of_ratio(e / float(UNIT)), RATE, folder
    )
