"""The schedule of fines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Violation code, fine in high-density areas, fine elsewhere.
FINES = [
    (14, 115, 115),
    (21, 65, 45),
    (36, 50, 50),
    (38, 65, 35),
]


def fine_values() -> str:
    """The schedule as the rows of a SQL ``VALUES`` clause."""
    return ", ".join(str(row) for row in FINES)


def fine_schedule(spark: SparkSession) -> DataFrame:
    """One row per priced code, with the whole-dollar average of its two fines."""
    return spark.sql(
        f"SELECT * FROM VALUES {fine_values()} "
        "AS fines(violation_code, fine_high, fine_other)"
    ).withColumn("average_fine", F.expr("(fine_high + fine_other) div 2").cast("int"))


# The last issuer precinct of the area with high density, and what the
# fines rise by in the second half of each fiscal year.
DENSE_UP_TO = 12
RISE = 5


def area_of(precinct: Column) -> Column:
    """``high`` or ``other``, as the schedule has it; null for no precinct."""
    return F.when(precinct <= DENSE_UP_TO, "high").when(precinct > DENSE_UP_TO, "other")


def fine_periods(spark: SparkSession, years: Sequence[int]) -> DataFrame:
    """The fine of each priced code and area with the dates it is valid: two periods in
    each fiscal year. ``valid_to`` is the last day."""
    areas = fine_schedule(spark).select(
        "violation_code",
        F.explode(F.map_from_arrays(
            F.array(F.lit("high"), F.lit("other")), F.array("fine_high", "fine_other")
        )).alias("area", "fine"),
    )
    year = F.explode(F.array(*[F.lit(y) for y in years]).cast("array<int>")).alias("year")
    halves = F.explode(F.array(
        F.struct(
            F.make_date(F.col("year") - 1, F.lit(7), F.lit(1)).alias("valid_from"),
            F.make_date(F.col("year") - 1, F.lit(12), F.lit(31)).alias("valid_to"),
            F.col("fine"),
        ),
        F.struct(
            F.make_date(F.col("year"), F.lit(1), F.lit(1)).alias("valid_from"),
            F.make_date(F.col("year"), F.lit(6), F.lit(30)).alias("valid_to"),
            (F.col("fine") + RISE).alias("fine"),
        ),
    )).alias("p")
    each = areas.select("*", year).select("violation_code", "area", halves)
    return each.select("violation_code", "area", "p.valid_from", "p.valid_to", "p.fine")
