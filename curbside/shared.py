"""Stages shared by all queries a session runs on one folder of tables."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.sources.order_tables import SOURCE_TABLES, order_tables, tickets_of
from curbside.stages import StoredStages, TicketStages, read_stored, write_stages

# A row of the joined tables, decoded, against its bytes in the files.
WIDENING = 4

_lock = threading.Lock()

# What a session knows is kept on the session itself and goes when it does.
_KNOWN = "_curbside_stages"
_REACHED = "_curbside_reached"


class PreparedStages(StoredStages):
    """Stages computed from the source until :meth:`prepare` has written their
    table, and read from it after.

    Every attempt to write has a folder of its own, removed if it fails.
    """

    def __init__(
        self,
        raw: DataFrame,
        folder: str,
        source_bytes: int,
        read: Callable[[Sequence[str]], DataFrame] | None = None,
    ) -> None:
        super().__init__(raw, None, None, read)
        self._folder = folder
        self._source_bytes = source_bytes
        self._write_lock = threading.Lock()

    def prepare(self) -> PreparedStages:
        """Write the table unless that is done. This is the one step that works
        when it is called; everything else is a plan."""
        with self._write_lock:
            if self._stored is None:
                path = f"{self._folder}/{uuid.uuid4().hex}"
                try:
                    write_stages(
                        TicketStages(self._raw, read=self._read), path, self._source_bytes
                    )
                except BaseException:
                    remove(self._raw.sparkSession, path)
                    raise
                self._stored = read_stored(self._raw, path)
        return self

    @property
    def years(self) -> list[int]:
        of = StoredStages if self._stored is not None else TicketStages
        return of.years.func(self)

    def _survivors(self, columns: Sequence[str]) -> DataFrame:
        of = StoredStages if self._stored is not None else TicketStages
        return of._survivors(self, columns)

    def _clean(self, columns: Sequence[str]) -> DataFrame:
        of = StoredStages if self._stored is not None else TicketStages
        return of._clean(self, columns)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder on any storage Spark can write to."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def listing(spark: SparkSession, paths: Iterable[str]) -> tuple[int, int]:
    """Size of all files in the folders, and a digest of their paths, sizes and
    modification times; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    row = (
        files.load(list(paths))
        .agg(
            F.sum("length"),
            F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")),
        )
        .first()
    )
    return row[0] or 0, int(row[1] or 0)


def shared_folder(spark: SparkSession) -> str | None:
    """The folder all executors can reach, if the session names one. On a cluster a
    path of the local file system is none, since each executor has its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder or spark.sparkContext.master.startswith("local"):
        return folder
    return folder if "://" in folder and not folder.startswith("file:") else None


def reached_by_all(spark: SparkSession, folder: str) -> bool:
    """Whether the driver finds what tasks write to the folder, tried once a session
    with a row of each of some tasks. Where every executor has a disk of its own, the
    rows of the others are missing."""
    known = spark.__dict__.setdefault(_REACHED, {})
    if folder not in known:
        tasks = max(4, spark.sparkContext.defaultParallelism)
        path = f"{folder}/reached-{uuid.uuid4().hex}"
        try:
            spark.range(0, tasks, 1, tasks).write.parquet(path)
            known[folder] = spark.read.schema("id bigint").parquet(path).count() == tasks
        except Exception:  # nobody can write there, or a task reads what is not there
            known[folder] = False
        finally:
            remove(spark, path)
    return known[folder]


def work_folder(spark: SparkSession) -> str:
    """A folder for what a query writes and reads again: :func:`shared_folder`; on a
    single machine without one, a temporary folder. On a cluster without one it is the
    session's checkpoint folder or else one in its warehouse, whatever their file
    system, if all executors are found to reach it."""
    folder = shared_folder(spark)
    if folder:
        return folder.rstrip("/")
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        return tempfile.mkdtemp(prefix="curbside-")
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
    for folder in (named, warehouse and f"{warehouse.rstrip('/')}/curbside-work"):
        if folder and reached_by_all(spark, folder.rstrip("/")):
            return folder.rstrip("/")
    raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def own_folder(spark: SparkSession, name: str) -> str:
    """A folder below :func:`work_folder` that no other query writes to."""
    return f"{work_folder(spark)}/curbside/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read from there, so that it is computed once."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ticket_reader(
    spark: SparkSession, folder: str
) -> tuple[DataFrame, Callable[[Sequence[str]], DataFrame]]:
    """All tickets of the order tables, and a function that makes some columns."""
    tables = order_tables(spark, folder)
    return tickets_of(tables), partial(tickets_of, tables)


def stages_for(spark: SparkSession, folder: str) -> TicketStages:
    """Stages of the tickets in ``folder``, the same object for the whole session as
    long as no file of the source changes.

    Where ``spark.checkpoint.dir`` names a shared folder, ``prepare()`` writes the
    deduplicated tickets there once and every query made after that reads them; a
    lost executor costs no more than its running tasks. Else each query computes
    its stages from the tables, for only the columns it uses.
    """
    tables = [f"{folder.rstrip('/')}/{name}.parquet" for name in SOURCE_TABLES]
    size, state = listing(spark, tables)
    shared = shared_folder(spark)
    with _lock:
        of_session = spark.__dict__.setdefault(_KNOWN, {})
        known = of_session.get((folder, shared))
        if known is None or known[0] != state:
            raw, read = ticket_reader(spark, folder)
            if shared:
                place = f"{shared.rstrip('/')}/curbside/{spark.sparkContext.applicationId}"
                stages = PreparedStages(raw, place, size * WIDENING, read)
            else:
                stages = TicketStages(raw, read=read)
            of_session[folder, shared] = known = state, stages
        return known[1]


def prepared_stages_for(spark: SparkSession, folder: str) -> TicketStages:
    """:func:`stages_for`, with the shared table written where there is a place."""
    stages = stages_for(spark, folder)
    return stages.prepare() if isinstance(stages, PreparedStages) else stages
