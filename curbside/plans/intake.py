"""Deduplication of files that arrive one after another."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.incremental import IncrementalTickets
from curbside.plans.registry import query
from curbside.schema import FISCAL_YEAR, TICKET_COLUMNS
from curbside.shared import work_folder
from curbside.stages import TicketStages
from curbside.streaming import StreamIntake

FILES, BATCHES = 4, 2


def _write_parts(raw: DataFrame, path: str) -> DataFrame:
    """The tickets written without a shuffle as files of ``FILES`` parts, by a hash of
    all columns, and read from there with the ``part`` of each."""
    part = F.pmod(F.xxhash64(*raw.columns), F.lit(FILES)).cast("int")
    parts = raw.withColumn("part", part)
    parts.write.partitionBy("part").parquet(path)
    return raw.sparkSession.read.schema(parts.schema).parquet(path)


@query(f"SELECT {', '.join(TICKET_COLUMNS)} FROM deduplicated", on="deduplicated")
def incremental_dedup(stages: TicketStages) -> DataFrame:
    """One ticket per key and file, from a table begun with a part of the tickets and
    three further parts added to it. Copies of one ticket fall into different parts."""
    raw = stages.raw()
    spark = raw.sparkSession
    folder = f"{work_folder(spark)}/curbside/incremental-{uuid.uuid4().hex}"
    arrived = _write_parts(raw, f"{folder}/files")
    table = IncrementalTickets(spark, f"{folder}/table", buckets=2)
    for number in range(FILES):
        table.add(arrived.filter(F.col("part") == number).drop("part"))
    found = table.tickets()
    return raw.limit(0) if found is None else found.select(FISCAL_YEAR, *stages.columns)


@query(f"SELECT {', '.join(TICKET_COLUMNS)} FROM deduplicated", on="deduplicated")
def streamed_dedup(stages: TicketStages) -> DataFrame:
    """One ticket per key and file, of all tickets written to a folder as files and taken
    in by a stream, in ``BATCHES`` batches of as many files however many were written:
    each batch merges the buckets it meets, so their cost goes by the batches."""
    raw = stages.raw()
    spark = raw.sparkSession
    folder = f"{work_folder(spark)}/curbside/stream-{uuid.uuid4().hex}"
    parts = _write_parts(raw, f"{folder}/files")
    files = len(parts.inputFiles())
    at_once = max(1, math.ceil(files / BATCHES))
    arriving = spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", at_once)
    intake = StreamIntake(spark, folder, buckets=2)
    intake.run(arriving.parquet(f"{folder}/files").drop("part")).awaitTermination()
    found = intake.tickets()
    return raw.limit(0) if found is None else found.select(FISCAL_YEAR, *stages.columns)
