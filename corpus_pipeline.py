"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage is a function of the session, the rows its predecessor kept and the
folder of the tables, and returns rows like its input; the last returns the packed
pieces. :func:`run` writes each stage's rows to the shared folder and reads them
again, so a stage reads what the one before has finished. Extra columns of the
documents pass through; null and empty texts, repeated rows and empty tables are as
the operators define them.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.llm.common import read_table, written
from curbside.llm.language import UNKNOWN, language_of, learn_languages
from curbside.llm.packing import pack_documents
from curbside.llm.secret_scan import learned_cutoffs, without_secrets
from curbside.llm.simhash import near_duplicate_groups
from curbside.llm.toxicity import learn_toxicity, toxicity_of

TOXIC_FROM = 0.5


def _unused(names: Collection[str], name: str) -> str:
    """``name``, or one like it that is in no case among ``names``."""
    while name.lower() in {known.lower() for known in names}:
        name += "_"
    return name


def _with(docs: DataFrame, value: Column, keep) -> DataFrame:
    """The rows whose ``value`` is to ``keep``; the value's column is named so that
    it clashes with none."""
    name = _unused(docs.columns, "decision")
    return docs.withColumn(name, value).filter(keep(F.col(name))).select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language. Rejected are those without one: without a letter, or
    as near to another language's codeword. Other texts keep their row as it is;
    where no row names a language nothing can be learned and only texts without a
    letter go."""
    model = learn_languages(docs, F.lit(True))

    def keep(found: Column) -> Column:
        if not model.languages:
            return F.regexp_like("text", F.lit(r"\p{L}"))
        return (found["lang"] != UNKNOWN) & ~found["ambiguous"]

    return _with(docs, language_of(F.col("text"), model), keep)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC_FROM``. The network learns from the
    labelled documents among the rows; without both labels it rejects by no more
    than their common one, and without any label nothing."""
    net = learn_toxicity(docs, read_table(spark, sf_dir, "labels"), F.lit(True))
    return _with(docs, toxicity_of(F.col("text"), net), lambda score: score < TOXIC_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: of those with the smallest id the one whose hash of id and
    text is smallest. Unlike texts with one id are two documents, rows without an id are
    documents like others and come after those with one, and of repeated rows one stays.
    """
    names = docs.schema.fieldNames()
    key, id_there, key_there = (_unused(names, n) for n in ("row_key", "kept_id", "kept_key"))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    groups = near_duplicate_groups(
        keyed.select("doc_id", "text", F.col(key).alias("row_key")), carry=["row_key"]
    )
    first = F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "row_key"))
    kept = groups.groupBy("root").agg(first.alias("row")).select(
        F.col("row.doc_id").alias(id_there), F.col("row.row_key").alias(key_there)
    )
    same = F.col("doc_id").eqNullSafe(F.col(id_there)) & (F.col(key) == F.col(key_there))
    chosen = keyed.join(written(kept, "simhash-kept"), same, "left_semi")
    again = chosen.groupBy("doc_id", key).count().filter("count > 1").select(
        F.col("doc_id").alias(id_there), F.col(key).alias(key_there)
    )
    names_of = [F.col(name) for name in names]
    once = chosen.join(again, same, "left_anti")
    one_of = chosen.join(again, same, "left_semi").dropDuplicates(["doc_id", key])
    return once.select(*names_of).unionByName(one_of.select(*names_of))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by the name of its kind, ``n_chars``
    counted anew where that column is there."""
    clean = docs.withColumn("text", without_secrets(F.col("text"), learned_cutoffs(docs)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.length("text").cast(kind))
    return clean.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with the sequence and the place they are packed in."""
    return pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

# Trained models, XXH64 with a seed and byte-level BPE are beyond SQL; the stages are
# held against brute force in tests/llm.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that every stage kept."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
