"""The cleaning stages of one ticket source: raw, deduplicated, valid, clean.

Deduplication comes first and the date filter second, so a copy with a good date
can lose to one with a bad date. Keys are unique per file, not across years.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.functions.calendar import fiscal_year_of, issue_date_of
from curbside.functions.clock import with_parts
from curbside.operators import compared_columns, keep_first
from curbside.schema import FISCAL_YEAR, KEY, SURVIVOR_ORDER

STATUS = "ticket_status"
CLEAN = "clean"
KEYLESS = "keyless"
OUT_OF_RANGE = "out_of_range"
UNDATED = "undated"

# Derived column: the ticket column it is made of.
DERIVED = {
    "issue_dt": "issue_date",
    STATUS: "issue_date",
    "hour": "violation_time",
    "am_pm": "violation_time",
}


def status_of(date: Column, fiscal_year: Column, key: Column) -> Column:
    """What is wrong with a ticket, if anything. A null date is neither inside
    nor outside the fiscal year."""
    inside = fiscal_year_of(date) == fiscal_year
    return (
        F.when(inside & key.isNotNull(), CLEAN)
        .when(inside, KEYLESS)
        .when(~inside, OUT_OF_RANGE)
        .otherwise(UNDATED)
    )


class TicketStages:
    """Stages as lazy DataFrames, each computed for the columns asked for.

    Every method takes the names of the columns wanted beside ``file_fy``; none
    means all ticket columns. After deduplication the parsed date ``issue_dt``,
    the ``ticket_status`` and the parts ``hour`` and ``am_pm`` of the violation
    time may be named too. Naming columns matters where the stages are computed
    from the source: see :func:`keep_first`.

    ``raw`` is the source's table, and ``read``, where given, makes it of the
    columns asked for alone, so that a source joins only what they need.
    ``years`` are the fiscal years of the source, where the caller knows them.
    """

    def __init__(
        self,
        raw: DataFrame,
        years: Sequence[int] | None = None,
        read: Callable[[Sequence[str]], DataFrame] | None = None,
    ) -> None:
        self._raw = raw
        self._years = years
        self._read = read

    def _source(self, columns: Sequence[str]) -> DataFrame:
        names = list(dict.fromkeys([FISCAL_YEAR, *columns]))
        return self._read(names) if self._read else self._raw.select(*names)

    @cached_property
    def years(self) -> list[int]:
        """The fiscal years there are tickets of, looked up unless given."""
        if self._years is not None:
            return sorted(self._years)
        return sorted(row[0] for row in self._year_of_each().distinct().collect())

    @property
    def columns(self) -> list[str]:
        """All ticket columns beside ``file_fy``."""
        return [c for c in self._raw.columns if c != FISCAL_YEAR]

    def _year_of_each(self) -> DataFrame:
        return self._source([])

    def raw(self, *columns: str) -> DataFrame:
        return self._source(columns or self.columns)

    def deduplicated(self, *columns: str) -> DataFrame:
        """One row per (``file_fy``, key); the null key counts as one key."""
        return self._survivors(columns or self.columns)

    def valid(self, *columns: str) -> DataFrame:
        """Survivors dated inside their file's fiscal year."""
        columns = columns or tuple(self.columns)
        dated = self._survivors([*columns, STATUS])
        return dated.filter(F.col(STATUS).isin(CLEAN, KEYLESS)).select(FISCAL_YEAR, *columns)

    def clean(self, *columns: str) -> DataFrame:
        """Valid tickets that have a key."""
        columns = columns or tuple(self.columns)
        return self._clean(columns).select(FISCAL_YEAR, *columns)

    def _clean(self, columns: Sequence[str]) -> DataFrame:
        # The status says the key is not null; said once more as a filter on the
        # grouping key, Spark applies it before the deduplication.
        tickets = self._survivors([*columns, KEY, STATUS])
        return tickets.filter(F.col(KEY).isNotNull() & (F.col(STATUS) == CLEAN))

    def _survivors(self, columns: Sequence[str]) -> DataFrame:
        columns = list(dict.fromkeys(columns))
        others = [c for c in self.columns if c != KEY and c not in SURVIVOR_ORDER]
        needed = {DERIVED.get(c, c) for c in columns}
        order = compared_columns([*SURVIVOR_ORDER, *others], needed)
        survivors = keep_first(self._source([KEY, *order]), [FISCAL_YEAR, KEY], order, needed)
        if "issue_date" in needed:
            survivors = survivors.withColumn("issue_dt", issue_date_of(F.col("issue_date")))
            status = status_of(F.col("issue_dt"), F.col(FISCAL_YEAR), F.col(KEY))
            survivors = survivors.withColumn(STATUS, status)
        if "violation_time" in needed:
            survivors = with_parts(survivors)
        return survivors.select(FISCAL_YEAR, *columns)


class StoredStages(TicketStages):
    """Stages read from deduplicated tickets written by :func:`write_stages`.

    Year and status are folders there, so a stage is a choice of folders: no
    query shuffles tickets again, and a query of the clean tickets reads neither
    key nor date unless it asks for them. Derived columns are read, not parsed
    again.
    """

    def __init__(
        self,
        raw: DataFrame,
        years: Sequence[int] | None,
        stored: DataFrame | None,
        read: Callable[[Sequence[str]], DataFrame] | None = None,
    ) -> None:
        super().__init__(raw, years, read)
        self._stored = stored

    @cached_property
    def years(self) -> list[int]:
        """The fiscal years there are folders of; no job is run for it."""
        if self._years is not None:
            return sorted(self._years)
        folders = (re.search(rf"/{FISCAL_YEAR}=(\d+)/", f) for f in self._stored.inputFiles())
        return sorted({int(m[1]) for m in folders if m})

    def _survivors(self, columns: Sequence[str]) -> DataFrame:
        return self._stored.select(FISCAL_YEAR, *dict.fromkeys(columns))

    def _clean(self, columns: Sequence[str]) -> DataFrame:
        return self._survivors([*columns, STATUS]).filter(F.col(STATUS) == CLEAN)


# One task of the deduplication sorts about this much.
SHUFFLE_BYTES = 512 * 1024**2


def shuffle_partitions_for(
    source_bytes: int, configured: int, target_bytes: int = SHUFFLE_BYTES
) -> int:
    """Shuffle partitions to deduplicate so many bytes with, about ``target_bytes``
    for each, and at least as many as the session is configured for."""
    return max(configured, math.ceil(source_bytes / target_bytes))


def _session_like(spark: SparkSession, **settings: str) -> SparkSession:
    """A session with the settings of another and these, which that one keeps out of."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if name.startswith("spark.sql.") and spark.conf.isModifiable(name):
            own.conf.set(name, value)
    for name, value in settings.items():
        own.conf.set(name.replace("_", "."), value)
    return own


def write_stages(
    stages: TicketStages,
    path: str,
    source_bytes: int = 0,
    target_bytes: int = SHUFFLE_BYTES,
) -> None:
    """Write the deduplicated tickets once, for many queries to read.

    Given the size of the source, this one wide shuffle is split finely enough
    for it: ``target_bytes`` of it for a task. The write has a session of its own,
    so the caller's settings, fit for the small shuffles of the queries, hold at
    all times. Before they are written tickets are rebalanced by folder: Spark
    splits the large folders among tasks and joins the small, so there are about as
    many files as the size calls for, however many partitions were sorted.
    """
    spark = stages.deduplicated(KEY).sparkSession
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = shuffle_partitions_for(source_bytes, configured, target_bytes)
    own = _session_like(spark, spark_sql_shuffle_partitions=str(count))
    view = f"curbside_{uuid.uuid4().hex}"
    stages.raw().createGlobalTempView(view)
    try:
        source = own.table(f"global_temp.{view}")
        tickets = TicketStages(source).deduplicated(*stages.columns, *DERIVED)
        balanced = tickets.hint("rebalance", FISCAL_YEAR, STATUS)
        balanced.write.partitionBy(FISCAL_YEAR, STATUS).parquet(path)
    finally:
        spark.catalog.dropGlobalTempView(view)


def read_stored(raw: DataFrame, path: str) -> DataFrame:
    """The table :func:`write_stages` made of ``raw``. Its schema is known, so no
    file is opened to find it."""
    lazy = TicketStages(raw)
    schema = lazy.deduplicated(*lazy.columns, *DERIVED).schema
    return raw.sparkSession.read.schema(schema).parquet(path)


def read_stages(
    raw: DataFrame, path: str, years: Sequence[int] | None = None
) -> StoredStages:
    """Stages of the tickets written to ``path`` from ``raw``."""
    return StoredStages(raw, years, read_stored(raw, path))
