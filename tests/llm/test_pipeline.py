"""The pipeline's stages one after another, each held against its own input."""

from __future__ import annotations

from collections import defaultdict

import __spark_entry__ as entry_points
import corpus_pipeline
from corpus_pipeline import (
    drop_near_duplicates,
    drop_toxic,
    identify_language,
    pack_sequences,
    redact_secrets,
)
from curbside.llm.common import written
from curbside.llm.secret_scan import base_spans
from tests.conftest import DATA
from tests.llm.conftest import LABELS
from tests.llm.test_simhash import plain_components, plain_fingerprint


def test_stages_of_the_whole_table(spark):
    folder = f"{DATA}/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    toxic = {
        r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()
    }
    all_ids = {r.doc_id for r in docs.select("doc_id").collect()}

    named = written(identify_language(spark, docs, folder), "t")
    assert named.columns == docs.columns
    assert {r.doc_id for r in named.select("doc_id").collect()} == all_ids

    clean = written(drop_toxic(spark, named, folder), "t")
    kept = {r.doc_id for r in clean.select("doc_id").collect()}
    labelled = [i for i in all_ids if toxic.get(i) is not None]
    right = sum((i in kept) == (toxic[i] == 0) for i in labelled)
    assert right / len(labelled) > 0.95

    single = written(drop_near_duplicates(spark, clean, folder), "t")
    prints = {r.doc_id: plain_fingerprint(r.text) for r in clean.collect()}
    roots = plain_components(prints)
    ids = [r.doc_id for r in single.select("doc_id").collect()]
    assert sorted(ids) == sorted(set(roots.values())) and len(ids) < len(prints)
    assert single.columns == docs.columns

    safe = written(redact_secrets(spark, single, folder), "t")
    assert safe.columns == docs.columns and safe.count() == len(ids)
    before = {r.doc_id: r.text for r in single.collect()}
    for r in safe.collect():
        assert not base_spans(r.text)
        assert r.n_chars == len(r.text)
        if not base_spans(before[r.doc_id]) and "[RANDOM]" not in r.text:
            assert r.text == before[r.doc_id]
    assert any(base_spans(t) for t in before.values())

    pieces = pack_sequences(spark, safe, folder)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == set(ids)

    whole = corpus_pipeline.run(spark, folder).collect()
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(tuple(r[c] for c in columns) for r in whole) == sorted(
        tuple(r) for r in pieces.select(*columns).collect()
    )
    ends = defaultdict(int)
    for r in sorted(whole, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 1024


def test_duplicates_go_by_row(spark, make_docs):
    """Unlike texts of one id, copies with and without ids, repeated rows, clashing names."""
    docs = make_docs(
        (5, "the first of two texts"), (5, "another text of that number"),
        (None, "a passage found three times"), (None, "a passage found three times"),
        (9, "A passage found three times"), (6, "said twice in one row"),
        (6, "said twice in one row"), (None, "without a number here"),
        (None, "Without a number here"), (8, None), (7, ""), (None, ""),
    ).withColumnRenamed("score", "Row_Key").withColumnRenamed("fingerprint", "kept_id")
    found = drop_near_duplicates(spark, docs, "")
    assert found.columns == docs.columns
    got = sorted((str(r.doc_id), (r.text or "").lower()) for r in found.collect())
    assert got == [
        ("5", "another text of that number"), ("5", "the first of two texts"),
        ("6", "said twice in one row"), ("7", ""), ("9", "a passage found three times"),
        ("None", "without a number here"),
    ]


def test_edges(spark, make_docs, folder_of):
    """Nulls, empty texts, repeated rows and clashing columns in every stage."""
    docs = make_docs(
        (1, "the end of the day", "en"), (2, "The end of the day", "en"), (3, None, None),
        (4, "", "fr"), (5, "12 !", None), (6, "le bout du jour", "fr"), (6, "le bout du jour", "fr"),
        (None, "une nuit de plus", "fr"), (7, "token = abcdef0123456789", "en"),
    ).withColumnRenamed("score", "decision")
    folder = folder_of(documents=docs, labels=spark.createDataFrame([], LABELS))
    named = identify_language(spark, docs, folder)
    assert sorted(str(r.doc_id) for r in named.collect()) == ["1", "2", "6", "6", "7", "None"]
    assert drop_toxic(spark, docs, folder).count() == 9
    single = drop_near_duplicates(spark, named, folder)
    assert sorted(str(r.doc_id) for r in single.collect()) == ["1", "6", "7", "None"]
    safe = {r.doc_id: r.text for r in redact_secrets(spark, docs, folder).collect()}
    assert safe[7] == "[ASSIGN+HEX]" and safe[3] is None and safe[1] == "the end of the day"
    for stage in (identify_language, drop_toxic, drop_near_duplicates, redact_secrets):
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert pack_sequences(spark, docs.limit(0), folder).count() == 0


def test_registered():
    names = entry_points.queries()
    assert "pipeline" in names
    assert sorted(n.split("_")[0] for n in names if n.startswith("op")) == sorted(
        f"op{i}" for i in range(1, 14)
    )
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "toxicity", "simhash_dedup", "secret_scan", "packing"
    ]
