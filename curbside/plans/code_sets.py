"""Codes that stand together among the most frequent of many precincts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.operators import frequent_sets, top_k
from curbside.plans.oracle import top_k_sql
from curbside.plans.precincts import CODES, codes_by_precinct
from curbside.plans.registry import query
from curbside.schema import FISCAL_YEAR
from curbside.shared import own_folder, stored
from curbside.stages import TicketStages

# Share of a year's precincts a set has to be found in.
PERCENT = 20

_LISTS_SQL = top_k_sql("clean", ["file_fy", "issuer_precinct"], ["violation_code"], CODES)


@query(f"""
WITH lists AS ({_LISTS_SQL}),
baskets AS (SELECT file_fy, count(DISTINCT coalesce(issuer_precinct, -1)) AS baskets
            FROM lists GROUP BY file_fy),
found AS (
  SELECT file_fy, items, count(*) AS support FROM (
    WITH RECURSIVE sets AS (
      SELECT file_fy, issuer_precinct, violation_code AS last, [violation_code] AS items
      FROM lists WHERE violation_code IS NOT NULL
      UNION ALL
      SELECT s.file_fy, s.issuer_precinct, l.violation_code, list_append(s.items, l.violation_code)
      FROM sets s JOIN lists l
        ON s.file_fy = l.file_fy AND s.issuer_precinct IS NOT DISTINCT FROM l.issuer_precinct
       AND l.violation_code > s.last)
    SELECT file_fy, items FROM sets)
  GROUP BY file_fy, items)
SELECT file_fy, array_to_string(items, ' ') AS codes, CAST(len(items) AS INTEGER) AS size,
       support, baskets AS precincts
FROM found JOIN baskets USING (file_fy) WHERE support * 100 >= {PERCENT} * baskets
""", on="clean")
def common_code_sets(stages: TicketStages) -> DataFrame:
    """Sets of any size that are among the ten most frequent codes of at least a fifth of a
    year's precincts, with the number of those precincts."""
    counted = codes_by_precinct(stages.clean("issuer_precinct", "violation_code"))
    folder = own_folder(counted.sparkSession, "code-sets")
    cells = stored(counted, f"{folder}/cells")
    lists = top_k(cells, [FISCAL_YEAR, "issuer_precinct"], ["violation_code"], CODES)
    found = frequent_sets(
        lists, [FISCAL_YEAR], "issuer_precinct", "violation_code", PERCENT, folder
    )
    return found.select(
        FISCAL_YEAR, F.array_join(F.col("items").cast("array<string>"), " ").alias("codes"),
        "size", "support", F.col("baskets").alias("precincts"),
    )
