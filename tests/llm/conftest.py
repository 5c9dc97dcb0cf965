from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
VECTORS = "vec_id long, embedding array<float>, label int"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (id, text) or (id, text, lang), with columns whose names clash
    with what operators add."""

    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None, 1, "x") for r in rows]
        return spark.createDataFrame(full, f"{DOCUMENTS}, score long, fingerprint string")

    return make


@pytest.fixture(scope="session")
def folder_of(spark, tmp_path_factory):
    """A folder of tables in the shape the queries read."""

    def write(**tables):
        path = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"{path}/{name}.parquet")
        return str(path)

    return write
