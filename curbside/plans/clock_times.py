"""Violation times: faults, labels, four-hour bins and the codes in them.

Functions of DataFrames take tickets with the ``hour`` and ``am_pm`` that the
stages or :func:`curbside.functions.clock.with_parts` give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbside.functions import clock
from curbside.operators import count_and_share, frequency, nested_top_k, top_k
from curbside.plans.oracle import top_k_sql
from curbside.plans.registry import query
from curbside.schema import FISCAL_YEAR
from curbside.stages import TicketStages


def _parts_of_time() -> tuple[Column, Column]:
    return F.col("hour"), F.col("am_pm")


def with_time(parts: DataFrame) -> DataFrame:
    """Tickets that have both parts, whatever the parts say."""
    return parts.dropna(subset=["hour", "am_pm"])


def valid_times(parts: DataFrame) -> DataFrame:
    """Tickets with a time on the twelve-hour clock, labelled as ``9:A``. A missing
    part fails the check, so it needs no filter of its own."""
    valid = parts.filter(clock.is_valid(*_parts_of_time()))
    return valid.withColumn("clock_time", clock.label_of(*_parts_of_time()))


def normalized(valid: DataFrame) -> DataFrame:
    """Writes hour 12 as 0 in both the hour and the label."""
    hour, meridiem = _parts_of_time()
    folded = clock.fold_twelve(hour)
    return valid.withColumns({"hour": folded, "clock_time": clock.label_of(folded, meridiem)})


def binned(parts: DataFrame) -> DataFrame:
    """Tickets with a valid time and its bin."""
    return normalized(valid_times(parts)).withColumn(
        "time_bin", clock.bin_of(*_parts_of_time())
    )


_TIME = ["hour", "am_pm"]
_TICKET = ["summons_number", "violation_code", "violation_time"]
_PARTS = [FISCAL_YEAR, *_TICKET, *_TIME]
_TIMED = [*_PARTS, "clock_time"]
_BINNED = [*_TIMED, "time_bin"]


def _parts(stages: TicketStages) -> DataFrame:
    return stages.clean(*_TICKET, *_TIME)


def _times(stages: TicketStages) -> DataFrame:
    return stages.clean(*_TIME)


def _coded_bins(stages: TicketStages) -> DataFrame:
    return binned(stages.clean("violation_code", *_TIME))


@query(f"SELECT {', '.join(_PARTS)} FROM parts", on="parts")
def violation_time_parts(stages: TicketStages) -> DataFrame:
    """Hour and meridiem of every clean ticket."""
    return _parts(stages).select(*_PARTS)


def _missing(stages: TicketStages) -> DataFrame:
    return count_and_share(
        _times(stages),
        [FISCAL_YEAR],
        clock.is_missing(*_parts_of_time()),
        "missing_time",
    )


_MISSING = "count(*) FILTER (WHERE hour IS NULL OR am_pm IS NULL)"


@query(f"SELECT file_fy, {_MISSING} AS missing_time_count FROM parts GROUP BY file_fy",
       on="parts")
def missing_time_count(stages: TicketStages) -> DataFrame:
    """Tickets without an hour or without a meridiem."""
    return _missing(stages).select(FISCAL_YEAR, "missing_time_count")


@query(f"""
SELECT file_fy, {_MISSING} AS missing_time_count, count(*) AS ticket_count,
       CAST({_MISSING} AS DOUBLE) / CAST(count(*) AS DOUBLE) AS missing_time_share
FROM parts GROUP BY file_fy
""", on="parts")
def missing_time_share(stages: TicketStages) -> DataFrame:
    """The part of all clean tickets these make up."""
    return _missing(stages)


def _distribution(tickets: DataFrame, column: str) -> DataFrame:
    return frequency(tickets, [FISCAL_YEAR, column]).orderBy(
        FISCAL_YEAR, F.desc("ticket_count"), column
    )


@query("""
SELECT file_fy, hour, count(*) AS ticket_count FROM parts
WHERE hour IS NOT NULL AND am_pm IS NOT NULL GROUP BY file_fy, hour
""", on="parts")
def hour_distribution(stages: TicketStages) -> DataFrame:
    """Hours as written, to see the impossible ones."""
    return _distribution(with_time(_times(stages)), "hour")


@query("""
SELECT file_fy, am_pm, count(*) AS ticket_count FROM parts
WHERE hour IS NOT NULL AND am_pm IS NOT NULL GROUP BY file_fy, am_pm
""", on="parts")
def meridiem_distribution(stages: TicketStages) -> DataFrame:
    """Meridiems as written, to see the impossible ones."""
    return _distribution(with_time(_times(stages)), "am_pm")


@query(f"SELECT {', '.join(_TIMED)} FROM timed", on="timed")
def valid_violation_time(stages: TicketStages) -> DataFrame:
    """Tickets with a valid time and its label."""
    return valid_times(_parts(stages)).select(*_TIMED)


@query("SELECT file_fy, clock_time, count(*) AS ticket_count FROM timed "
       "GROUP BY file_fy, clock_time", on="timed")
def clock_time_distribution(stages: TicketStages) -> DataFrame:
    """Labels before 12 and 0 are made one."""
    return frequency(valid_times(_times(stages)), [FISCAL_YEAR, "clock_time"])


@query(f"SELECT {', '.join(_TIMED)} FROM folded", on="folded")
def normalized_violation_time(stages: TicketStages) -> DataFrame:
    """Valid times with hour 12 written as 0."""
    return normalized(valid_times(_parts(stages))).select(*_TIMED)


@query(f"SELECT {', '.join(_BINNED)} FROM binned", on="binned")
def time_bins(stages: TicketStages) -> DataFrame:
    """Valid times with their four-hour bin."""
    return binned(_parts(stages)).select(*_BINNED)


@query(top_k_sql("binned", ["file_fy", "time_bin"], ["violation_code"], 3,
                 where="time_bin IS NOT NULL"), on="binned")
def top3_codes_by_time_bin(stages: TicketStages) -> DataFrame:
    """The three most frequent codes of each bin.

    Only hours below 0 have no bin. Asking for the hour, and not for the bin,
    spares working the bin out a second time where Spark applies the filter.
    """
    per_bin = [FISCAL_YEAR, "time_bin"]
    in_bins = _coded_bins(stages).filter(F.col("hour") >= 0)
    counted = frequency(in_bins, [*per_bin, "violation_code"])
    return top_k(counted, per_bin, ["violation_code"], 3).orderBy(*per_bin, "rank")


@query(top_k_sql("timed", ["file_fy"], ["violation_code"], 3), on="timed")
def top3_codes_timed(stages: TicketStages) -> DataFrame:
    """The three most frequent codes of tickets with a valid time."""
    timed = valid_times(stages.clean("violation_code", *_TIME))
    counted = frequency(timed, [FISCAL_YEAR, "violation_code"])
    return top_k(counted, [FISCAL_YEAR], ["violation_code"], 3).orderBy(FISCAL_YEAR, "rank")


_TOP_BINS = top_k_sql(
    "binned SEMI JOIN top3 USING (file_fy, violation_code)",
    ["file_fy", "violation_code"], ["time_bin"], 3,
)


@query(f"""
WITH top3 AS ({top_k_sql("binned", ["file_fy"], ["violation_code"], 3)})
SELECT b.file_fy, t.rank AS code_rank, b.violation_code, b.rank, b.time_bin, b.ticket_count
FROM ({_TOP_BINS}) b
JOIN top3 t ON b.file_fy = t.file_fy AND b.violation_code = t.violation_code
""", on="binned")
def top3_bins_by_top_code(stages: TicketStages) -> DataFrame:
    """The three most frequent bins of each of those codes."""
    cells = frequency(_coded_bins(stages), [FISCAL_YEAR, "violation_code", "time_bin"])
    return (
        nested_top_k(cells, FISCAL_YEAR, "violation_code", "time_bin", 3, 3)
        .withColumnRenamed("group_rank", "code_rank")
        .select(
            FISCAL_YEAR, "code_rank", "violation_code", "rank", "time_bin", "ticket_count"
        )
        .orderBy(FISCAL_YEAR, "code_rank", "rank")
    )
