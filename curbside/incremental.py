"""Deduplicated tickets that take in further files without a rewrite.

The survivors lie in buckets of (fiscal year, hash of the key). Each commit is a folder
of its own; a manifest lists the bucket folders that are live. Beside each goes a Bloom
filter of its keys. A new file's tickets are tested against the filters first: in
buckets where no key can be known they are written beside what is there, and only
buckets with a key that may be known are read, merged and rewritten. Years a file has
no ticket of are never looked at.

A table is read by the folders its manifest lists, so a commit that fails leaves it as
it was, and readers of the version before go on reading that.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from curbside.operators import compared_columns, keep_first
from curbside.schema import FISCAL_YEAR, KEY, SURVIVOR_ORDER

BUCKET = "key_bucket"
PROBES = 3


@dataclass(frozen=True)
class Folder:
    """The tickets of one bucket that one commit wrote."""

    commit: str
    year: int
    bucket: int

    @property
    def place(self) -> str:
        return f"commit={self.commit}/{FISCAL_YEAR}={self.year}/{BUCKET}={self.bucket}"


def _hash() -> Column:
    return F.xxhash64(FISCAL_YEAR, KEY)


def _bucket(buckets: int) -> Column:
    return F.pmod(_hash(), F.lit(buckets)).cast("int")


def _probes(bits: int) -> list[Column]:
    """Places of a key's bits in a filter of so many; the hash has another seed than
    the one that chose the bucket."""
    h = F.xxhash64(F.lit(bits), KEY, FISCAL_YEAR)
    step = F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    return [
        F.pmod(h.bitwiseAND(F.lit((1 << 31) - 1)) + k * step, F.lit(bits)) for k in range(PROBES)
    ]


class IncrementalTickets:
    """Survivors at ``path``. ``buckets`` of a year are as many as make one about the
    size of a task's work; ``filter_bits`` are for the keys of one bucket, some ten a
    key. Both are chosen when the table is begun and stay with it."""

    def __init__(
        self, spark: SparkSession, path: str, buckets: int = 64, filter_bits: int = 1 << 17
    ) -> None:
        self._spark = spark
        self._path = path.rstrip("/")
        self._buckets = buckets
        self._bits = filter_bits
        self._schemas: dict[str, StructType] = {}
        self._version, self._live = self._latest()

    # -- reading

    def _exists(self, path: str) -> bool:
        target = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        conf = self._spark._jsc.hadoopConfiguration()
        return target.getFileSystem(conf).exists(target)

    def _latest(self) -> tuple[int, list[Folder]]:
        version = 0
        while self._exists(f"{self._path}/manifest/{version + 1}/_SUCCESS"):
            version += 1
        if not version:
            return 0, []
        rows = self._spark.read.parquet(f"{self._path}/manifest/{version}").collect()
        for row in rows[:1]:
            self._buckets, self._bits = row.buckets, row.filter_bits
        return version, [Folder(r.commit, r.year, r.bucket) for r in rows]

    @property
    def folders(self) -> list[Folder]:
        """What is live: some folders for each bucket of each year."""
        return list(self._live)

    def _read(self, kind: str, folders: Collection[Folder]) -> DataFrame | None:
        if not folders:
            return None
        base = f"{self._path}/{kind}"
        rows = self._load(kind, base, [f"{base}/{f.place}" for f in folders])
        return rows.drop("commit")

    def _load(self, kind: str, base: str, places: list[str]) -> DataFrame:
        """Written rows; once their schema is known no file is opened to find it."""
        reader = self._spark.read.option("basePath", base)
        known = self._schemas.get(kind)
        rows = (reader.schema(known) if known else reader).parquet(*places)
        if not known:
            kept = [f for f in rows.schema.fields if f.name != "commit"]
            self._schemas[kind] = StructType(kept)
        return rows

    def tickets(self) -> DataFrame | None:
        """One ticket per (fiscal year, key); none before the first file."""
        found = self._read("tickets", self._live)
        return None if found is None else found.drop(BUCKET)

    # -- writing

    def add(self, tickets: DataFrame) -> list[tuple[int, int]]:
        """Take in the tickets of a further file. Returns the buckets (year, number)
        that had to be rewritten.

        Tickets without a key count as one key. Of equal keys the first in the fixed
        order of the columns survives, whichever file it came with, so the table does
        not depend on the order of the files.
        """
        others = [c for c in tickets.columns if c not in (FISCAL_YEAR, KEY, *SURVIVOR_ORDER)]
        order = compared_columns([*SURVIVOR_ORDER, *others], None)
        survivors = keep_first(tickets, [FISCAL_YEAR, KEY], order)
        commit = uuid.uuid4().hex
        staged = f"{self._path}/staged/{commit}"
        self._write(survivors.withColumn(BUCKET, _bucket(self._buckets)), staged)
        new = self._load("tickets", staged, [staged])

        arrived = {(r[0], r[1]) for r in new.select(FISCAL_YEAR, BUCKET).distinct().collect()}
        near = [f for f in self._live if (f.year, f.bucket) in arrived]
        met = self._may_be_known(new, near)
        old = [f for f in near if (f.year, f.bucket) in met]
        fresh = new
        if old:
            again = [f"{FISCAL_YEAR}={year}/{BUCKET}={bucket}" for year, bucket in sorted(met)]
            part = self._load("tickets", staged, [f"{staged}/{place}" for place in again])
            both = self._read("tickets", old).unionByName(part)
            merged = keep_first(both, [FISCAL_YEAR, KEY, BUCKET], order)
            rest = [
                f"{staged}/{FISCAL_YEAR}={year}/{BUCKET}={bucket}"
                for year, bucket in sorted(arrived - met)
            ]
            fresh = merged
            if rest:
                fresh = merged.unionByName(self._load("tickets", staged, rest))
        target = f"{self._path}/tickets/commit={commit}"
        self._write(fresh, target)
        self._write_filters(commit)
        written = [Folder(commit, year, bucket) for year, bucket in sorted(arrived)]
        self._commit([f for f in self._live if f not in set(old)] + written)
        return sorted(met)

    def _write(self, tickets: DataFrame, path: str) -> None:
        """A bucket's tickets in as few files as their size calls for."""
        balanced = tickets.hint("rebalance", FISCAL_YEAR, BUCKET)
        balanced.write.partitionBy(FISCAL_YEAR, BUCKET).parquet(path)

    def replace_years(self, tickets: DataFrame) -> None:
        """Put the tickets of a changed file in the place of all there are of its
        years; keys are unique within a year, so no other year is touched."""
        years = {r[0] for r in tickets.select(FISCAL_YEAR).distinct().collect()}
        live, self._live = self._live, [f for f in self._live if f.year not in years]
        try:
            self.add(tickets)
        except BaseException:
            self._live = live
            raise

    def _may_be_known(self, new: DataFrame, near: list[Folder]) -> set[tuple[int, int]]:
        """The buckets in which a filter has all bits of a key that arrived."""
        filters = self._read("filters", near)
        if filters is None:
            return set()
        word = reduce(
            Column.__and__,
            [
                F.getbit(F.element_at("words", (F.shiftright(at, 6) + 1).cast("int")),
                         at.bitwiseAND(F.lit(63)).cast("int")) == 1
                for at in (F.col(f"probe{k}") for k in range(PROBES))
            ],
        )
        keys = new.select(
            FISCAL_YEAR, BUCKET, *[p.alias(f"probe{k}") for k, p in enumerate(_probes(self._bits))]
        )
        hit = keys.join(filters, [FISCAL_YEAR, BUCKET]).filter(word)
        return {(r[0], r[1]) for r in hit.select(FISCAL_YEAR, BUCKET).distinct().collect()}

    def _write_filters(self, commit: str) -> None:
        """Of each bucket that the commit wrote, its filter: an array of longs."""
        base = f"{self._path}/tickets"
        tickets = self._load("tickets", base, [f"{base}/commit={commit}"])
        bucket = [FISCAL_YEAR, BUCKET]
        set_bits = tickets.select(*bucket, F.explode(F.array(*_probes(self._bits))).alias("at"))
        word = F.expr("shiftleft(1L, cast(at & 63 AS INT))")
        some = set_bits.select(*bucket, F.shiftright("at", 6).alias("number"), word.alias("word"))
        last = (self._bits + 63) // 64 - 1
        numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")))
        none = tickets.select(*bucket).distinct().select(
            *bucket, numbers.alias("number"), F.lit(0).cast("long").alias("word")
        )
        words = some.unionByName(none).groupBy(*bucket, "number").agg(F.bit_or("word").alias("word"))
        in_order = F.array_sort(F.collect_list(F.struct("number", "word")))
        filters = words.groupBy(*bucket).agg(in_order.getField("word").alias("words"))
        filters.write.partitionBy(*bucket).parquet(f"{self._path}/filters/commit={commit}")

    def _commit(self, live: list[Folder]) -> None:
        rows = [(f.commit, f.year, f.bucket, self._buckets, self._bits) for f in live]
        types = "commit string, year int, bucket int, buckets int, filter_bits int"
        manifest = self._spark.createDataFrame(rows, types).coalesce(1)
        manifest.write.parquet(f"{self._path}/manifest/{self._version + 1}")
        self._version, self._live = self._version + 1, live
