"""The ticket stages as SQL common table expressions.

They state the same rules as the DataFrame stages in another form (a sorted
window instead of an aggregate, one statement instead of functions), so that a
mistake in one shows against the other.
"""

from __future__ import annotations

from curbside.functions.fines import fine_values
from curbside.schema import SURVIVOR_ORDER

_LINES = """
  SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_shipdate,
         n_name, s_nationkey, p_type, p_brand,
         year(l_shipdate) + CASE WHEN month(l_shipdate) >= 7 THEN 1 ELSE 0 END AS fy0,
         l_orderkey * 31 + l_linenumber * 17 + l_partkey AS k,
         (l_orderkey * 7 + l_partkey * 3 + l_linenumber) % 1440 AS m
  FROM lineitem
  LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN nation ON s_nationkey = n_nationkey
"""

_RAW = """
  SELECT
    CAST(coalesce(CASE WHEN l_orderkey % 37 = 0 THEN fy0 + 1 ELSE fy0 END, 1900) AS INTEGER)
      AS file_fy,
    CASE WHEN l_orderkey % 211 = 0 AND l_linenumber = 1 THEN NULL
         ELSE l_orderkey * 10 + l_linenumber END AS summons_number,
    CASE WHEN l_orderkey % 127 = 0 AND l_linenumber = 1 THEN NULL
         WHEN l_orderkey % 131 = 0 THEN '13/45/2015'
         WHEN l_orderkey % 137 = 0 THEN 'unknown'
         WHEN l_orderkey % 5 = 0 THEN strftime(l_shipdate, '%-m/%-d/%Y')
         ELSE strftime(l_shipdate, '%m/%d/%Y') END AS issue_date,
    CASE WHEN k % 53 = 0 THEN '99' ELSE n_name END AS registration_state,
    CAST(CASE WHEN k % 100 < 14 THEN 21 WHEN k % 100 < 26 THEN 38
              WHEN k % 100 < 36 THEN 36 WHEN k % 100 < 45 THEN 14
              ELSE 1 + k % 99 END AS INTEGER) AS violation_code,
    p_type AS vehicle_body_type,
    CASE WHEN k % 61 = 0 THEN NULL ELSE p_brand END AS vehicle_make,
    CAST(CASE WHEN k % 7 = 0 THEN 0 ELSE l_suppkey % 25 END AS INTEGER)
      AS violation_precinct,
    CAST(CASE WHEN k % 6 = 0 THEN 0 ELSE s_nationkey END AS INTEGER) AS issuer_precinct,
    CASE WHEN l_orderkey % 101 = 0 THEN NULL
         WHEN l_orderkey % 103 = 0 THEN '0953'
         WHEN l_orderkey % 107 = 0 THEN '2553A'
         WHEN l_orderkey % 109 = 0 THEN 'A953A'
         WHEN l_orderkey % 113 = 0 THEN '10230'
         ELSE lpad(CAST(CASE WHEN (m % 720) // 60 = 0 AND k % 2 = 0 THEN 12
                             ELSE (m % 720) // 60 END AS VARCHAR), 2, '0')
              || lpad(CAST(m % 60 AS VARCHAR), 2, '0')
              || CASE WHEN m < 720 THEN 'A' ELSE 'P' END
    END AS violation_time,
    CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(k % 400 AS VARCHAR) END AS house_number,
    CASE WHEN k % 10 = 0 THEN NULL ELSE 'ST' END AS street_name,
    CASE WHEN k % 20 < 15 THEN NULL ELSE 'X' END AS intersecting_street
  FROM lines
"""

_ORDER = ", ".join(f"{c} ASC NULLS FIRST" for c in SURVIVOR_ORDER)

_DEDUP = f"""
  SELECT * EXCLUDE (copy_number),
         CAST(try_strptime(issue_date, '%m/%d/%Y') AS DATE) AS issue_dt
  FROM (SELECT *, row_number() OVER (PARTITION BY file_fy, summons_number
                                     ORDER BY {_ORDER}) AS copy_number
        FROM raw_tickets)
  WHERE copy_number = 1
"""

_VALID = """
  SELECT * FROM deduplicated
  WHERE issue_dt BETWEEN make_date(file_fy - 1, 7, 1) AND make_date(file_fy, 6, 30)
"""

_CLEAN = "SELECT * FROM valid WHERE summons_number IS NOT NULL"

_PARTS = """
  SELECT *, TRY_CAST(substr(violation_time, 1, 2) AS INTEGER) AS hour,
         nullif(substr(violation_time, 5, 5), '') AS am_pm
  FROM clean
"""

_TIMED = """
  SELECT *, CAST(hour AS VARCHAR) || ':' || am_pm AS clock_time
  FROM parts
  WHERE hour <= 12 AND am_pm IN ('A', 'P')
"""

_FOLDED = """
  SELECT * REPLACE (CASE WHEN hour = 12 THEN 0 ELSE hour END AS hour,
                    CASE clock_time WHEN '12:A' THEN '0:A' WHEN '12:P' THEN '0:P'
                         ELSE clock_time END AS clock_time)
  FROM timed
"""

_BINNED = """
  SELECT *, CASE WHEN hour BETWEEN 0 AND 3 AND am_pm = 'A' THEN 'MidNight'
                 WHEN hour BETWEEN 4 AND 7 AND am_pm = 'A' THEN 'Dawn'
                 WHEN hour BETWEEN 8 AND 11 AND am_pm = 'A' THEN 'Day'
                 WHEN hour BETWEEN 0 AND 3 AND am_pm = 'P' THEN 'Noon'
                 WHEN hour BETWEEN 4 AND 7 AND am_pm = 'P' THEN 'Dusk'
                 WHEN hour BETWEEN 8 AND 11 AND am_pm = 'P' THEN 'Night' END AS time_bin
  FROM folded
"""

_MONTHS = "SELECT *, CAST(month(issue_dt) AS INTEGER) AS issue_month FROM clean"

_SEASONS = """
  SELECT *, CASE WHEN issue_month IN (3, 4, 5) THEN 'Spring'
                 WHEN issue_month IN (6, 7, 8) THEN 'Summer'
                 WHEN issue_month IN (9, 10, 11) THEN 'Fall'
                 ELSE 'Winter' END AS season
  FROM months
"""

_FINES = f"""
  SELECT CAST(code AS INTEGER) AS violation_code, CAST(high AS INTEGER) AS fine_high,
         CAST(other AS INTEGER) AS fine_other,
         CAST((high + other) // 2 AS INTEGER) AS average_fine
  FROM (VALUES {fine_values()}) AS f(code, high, other)
"""

# Stage: the stage it reads, its statement.
_STAGES = {
    "lines": (None, _LINES),
    "raw_tickets": ("lines", _RAW),
    "deduplicated": ("raw_tickets", _DEDUP),
    "valid": ("deduplicated", _VALID),
    "clean": ("valid", _CLEAN),
    "priced": ("clean", _FINES),
    "parts": ("clean", _PARTS),
    "timed": ("parts", _TIMED),
    "folded": ("timed", _FOLDED),
    "binned": ("folded", _BINNED),
    "months": ("clean", _MONTHS),
    "seasons": ("months", _SEASONS),
}


def with_stages(last: str, sql: str) -> str:
    """``sql`` behind the expressions up to stage ``last``.

    A statement that starts with its own ``WITH`` goes on with that list.
    """
    chain: list[str] = []
    name: str | None = last
    while name is not None:
        before, text = _STAGES[name]
        chain.insert(0, f"{name} AS ({text})")
        name = before
    expressions = ",\n".join(chain)
    statement = sql.strip()
    if statement.upper().startswith("WITH "):
        return f"WITH {expressions},\n{statement[5:]}"
    return f"WITH {expressions}\n{statement}"


def top_k_sql(
    source: str, per: list[str], by: list[str], k: int, count: str = "count(*)",
    measure: str = "ticket_count", where: str = "true",
) -> str:
    """Largest ``k`` groups of ``by`` in each group of ``per``, ranked."""
    ties = ", ".join(f"{c} ASC NULLS FIRST" for c in by)
    columns = ", ".join(per + by)
    return f"""
SELECT {columns}, {measure}, CAST(place AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY {", ".join(per)}
                                   ORDER BY {measure} DESC NULLS LAST, {ties}) AS place
      FROM (SELECT {columns}, {count} AS {measure} FROM {source}
            WHERE {where} GROUP BY {columns}))
WHERE place <= {k}
"""
