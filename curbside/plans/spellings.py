"""Misspelled body types brought to their frequent forms before they are counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbside.operators import frequency, join_by_size, spelling_roots, top_k
from curbside.plans.oracle import top_k_sql
from curbside.plans.registry import query
from curbside.schema import FISCAL_YEAR
from curbside.shared import own_folder, stored
from curbside.stages import TicketStages

FACTOR = 10
BODY = "vehicle_body_type"

# The order tables hold no typing faults, so some tickets are read as if they had: a
# character left out in every 97th summons, one doubled in every 89th, both in some.
_TYPED_SQL = """
cut AS (
  SELECT file_fy, summons_number AS s,
         CASE WHEN summons_number % 97 = 0 AND length(vehicle_body_type) > 0
              THEN left(vehicle_body_type, CAST(summons_number % length(vehicle_body_type) AS INT))
                   || substr(vehicle_body_type,
                             CAST(summons_number % length(vehicle_body_type) AS INT) + 2)
              ELSE vehicle_body_type END AS v
  FROM clean),
typed AS (
  SELECT file_fy,
         CASE WHEN s % 89 = 0 AND length(v) > 0
              THEN left(v, CAST(s % length(v) AS INT) + 1) || substr(v, CAST(s % length(v) AS INT) + 1)
              ELSE v END AS vehicle_body_type
  FROM cut)
"""

_ROOTS_SQL = f"""{_TYPED_SQL},
known AS (SELECT vehicle_body_type AS v, count(*) AS n FROM typed GROUP BY v),
forms AS (
  SELECT a.v, (SELECT b.v FROM known b
               WHERE b.n >= {FACTOR} * a.n AND levenshtein(a.v, b.v) = 1
               ORDER BY b.n DESC, b.v LIMIT 1) AS form
  FROM known a),
roots AS (
  SELECT v, reached AS root FROM (
    WITH RECURSIVE steps AS (
      SELECT v, v AS reached, 0 AS step FROM known
      UNION ALL
      SELECT s.v, f.form, s.step + 1 FROM steps s JOIN forms f ON f.v = s.reached
      WHERE f.form IS NOT NULL)
    SELECT v, reached FROM steps QUALIFY row_number() OVER (PARTITION BY v ORDER BY step DESC) = 1))
"""


def _typed(tickets: DataFrame) -> DataFrame:
    def place(value: str) -> Column:
        return (F.col("summons_number") % F.char_length(value)).cast("int")

    def faulty(step: int, text: str, before: int, after: int) -> Column:
        written = F.concat(
            F.substr(text, F.lit(1), place(text) + before), F.substr(text, place(text) + after)
        )
        apt = (F.col("summons_number") % step == 0) & (F.char_length(text) > 0)
        return F.when(apt, written).otherwise(F.col(text))

    cut = tickets.withColumn(BODY, faulty(97, BODY, 0, 2))
    return cut.withColumn(BODY, faulty(89, BODY, 1, 1))


def _counted(stages: TicketStages, folder: str) -> DataFrame:
    counted = frequency(_typed(stages.clean("summons_number", BODY)), [FISCAL_YEAR, BODY])
    return stored(counted, f"{folder}/counts")


def _roots(counted: DataFrame, folder: str) -> DataFrame:
    of_all = counted.groupBy(BODY).agg(F.sum("ticket_count").alias("ticket_count"))
    return spelling_roots(of_all, BODY, "ticket_count", folder, FACTOR)


@query(f"""
WITH {_ROOTS_SQL}
SELECT k.v AS vehicle_body_type, k.n AS ticket_count, f.form, r.root
FROM known k JOIN forms f ON k.v IS NOT DISTINCT FROM f.v
             JOIN roots r ON k.v IS NOT DISTINCT FROM r.v
""", on="clean")
def body_type_spellings(stages: TicketStages) -> DataFrame:
    """Each body type as typed, the frequent one it is a fault of, and where that leads."""
    folder = own_folder(stages.raw().sparkSession, "spellings")
    return _roots(_counted(stages, folder), folder)


_CLEANED_SQL = top_k_sql("cleaned", ["file_fy"], ["vehicle_body_type"], 5)


@query(f"""
WITH {_ROOTS_SQL},
cleaned AS (
  SELECT file_fy, root AS vehicle_body_type
  FROM typed JOIN roots ON vehicle_body_type IS NOT DISTINCT FROM v)
{_CLEANED_SQL}
""", on="clean")
def top5_cleaned_body_type(stages: TicketStages) -> DataFrame:
    """The most frequent body types of each year with the faulty ones counted to them.

    Tickets are counted once; what meets the roots is counts of a year and type.
    """
    folder = own_folder(stages.raw().sparkSession, "spellings")
    counted = _counted(stages, folder)
    roots = _roots(counted, folder).select(BODY, "root")
    cleaned = (
        join_by_size(counted, roots, [BODY])
        .groupBy(FISCAL_YEAR, F.col("root").alias(BODY))
        .agg(F.sum("ticket_count").alias("ticket_count"))
    )
    return top_k(cleaned, [FISCAL_YEAR], [BODY], 5).orderBy(FISCAL_YEAR, "rank")
