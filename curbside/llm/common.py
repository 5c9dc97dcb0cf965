"""What several operators share: written intermediate tables, Arrow text, tokens."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE = "{folder}/{name}.parquet"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(TABLE.format(folder=folder, name=name))


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``; a
    temporary one only where that is unset and the master is local, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _own_folder(spark.sparkContext.applicationId)


@lru_cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"curbside-llm-{application}-")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts its lineage, is computed once,
    and outlives lost executors. Each call writes a folder of its own."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/curbside-llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(text: Column) -> Column:
    """UTF-8 of a text, nothing for null."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def bytes_and_offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with the bytes of all values, and where each begins (n + 1
    places from 0). Null counts as empty."""
    if column.null_count:
        empty = pa.scalar(b"" if pa.types.is_binary(column.type) else "", column.type)
        column = column.fill_null(empty)
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset : column.offset + len(column) + 1
    ]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def spans_of_rows(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows with about ``size`` bytes each, one row at least."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1
        end = min(max(end, start + 1), rows)
        yield start, end
        start = end


def sums_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values[offsets[i]:offsets[i + 1]]`` along the first axis for each i."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), np.float64)
    filled = np.flatnonzero(np.diff(offsets) > 0)
    if len(filled):
        out[filled] = np.add.reduceat(values, offsets[filled], axis=0)
    return out


def forest(n: int, neighbours) -> np.ndarray:
    """For each of ``n`` nodes the first node of its connected component.

    ``neighbours(frontier)`` gives a mask of the nodes next to any node of the
    frontier. Every node is asked for once.
    """
    root = np.full(n, -1, np.int64)
    for node in range(n):
        if root[node] >= 0:
            continue
        root[node] = node
        frontier = np.array([node])
        while len(frontier):
            frontier = np.flatnonzero(neighbours(frontier) & (root < 0))
            root[frontier] = node
    return root
