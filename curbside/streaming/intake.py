"""Ticket files taken in as they arrive, into one deduplicated table.

A structured stream lists the files and remembers in its checkpoint which it has handed
out; each of its batches is added to an :class:`IncrementalTickets`. What is kept of the
keys is that table's buckets and filters, on shared storage, not memory of the executors,
so a copy that comes years later still meets the ticket it copies, and the table is the
one a single pass over all files makes.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from curbside.functions.calendar import issue_date_of
from curbside.incremental import IncrementalTickets

LEDGER = "rows bigint, late bigint, latest date"


class StreamIntake:
    """A table at ``path`` with the stream's checkpoint and ledger beside it.

    A ticket is late if it is dated more than ``delay_days`` before the latest date of the
    batches before its own. Late tickets are counted, not dropped. Tickets without a
    date are never late.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        delay_days: int = 90,
        buckets: int = 64,
        filter_bits: int = 1 << 17,
    ) -> None:
        self._spark = spark
        self._path = path.rstrip("/")
        self._delay = delay_days
        self._buckets = buckets
        self._bits = filter_bits

    def _table(self, spark: SparkSession) -> IncrementalTickets:
        return IncrementalTickets(spark, f"{self._path}/table", self._buckets, self._bits)

    def _exists(self, path: str) -> bool:
        target = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self._spark._jsc.hadoopConfiguration()).exists(target)

    def tickets(self) -> DataFrame | None:
        """One ticket per (fiscal year, key) of the files taken in; None before any."""
        return self._table(self._spark).tickets()

    def ledger(self) -> DataFrame:
        """``batch``, its ``rows``, how many were ``late`` and their ``latest`` date."""
        folder = f"{self._path}/ledger"
        if not self._exists(folder):
            return self._spark.createDataFrame([], f"{LEDGER}, batch bigint")
        return self._spark.read.schema(f"{LEDGER}, batch bigint").parquet(folder)

    def run(self, arriving: DataFrame, available_now: bool = True) -> StreamingQuery:
        """Take in a stream of tickets: all files there are, or until it is stopped.

        Started again it goes on behind the last batch it finished. A batch that was cut
        off is handed out again with the same files: if it is in the ledger it is passed
        over, and if it had only reached the table, adding it once more changes nothing,
        for a ticket is a copy of itself.
        """
        writer = arriving.writeStream.foreachBatch(self.take).option(
            "checkpointLocation", f"{self._path}/checkpoint"
        )
        if available_now:
            writer = writer.trigger(availableNow=True)
        return writer.start()

    def take(self, tickets: DataFrame, batch: int) -> None:
        """Add one batch and enter it in the ledger."""
        entry = f"{self._path}/ledger/batch={batch}"
        if self._exists(f"{entry}/_SUCCESS"):
            return
        before = self.ledger().filter(F.col("batch") < batch).agg(F.max("latest")).first()[0]
        dated = issue_date_of(F.col("issue_date"))
        late = F.lit(False)
        if before is not None:
            late = dated < F.lit(before - dt.timedelta(days=self._delay))
        counts = tickets.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(late).alias("late"),
            F.max(dated).alias("latest"),
        )
        self._table(tickets.sparkSession).add(tickets)
        counts.coalesce(1).write.mode("overwrite").parquet(entry)
