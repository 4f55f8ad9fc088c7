"""Small tables with the awkward rows that every operator has to take."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def as_docs(spark):
    def make(texts, ids=None, langs=None):
        ids = range(len(texts)) if ids is None else ids
        langs = ["en"] * len(texts) if langs is None else langs
        rows = [(i, t, g, "s", None if t is None else len(t)) for i, t, g in zip(ids, texts, langs)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def table_of(spark, tmp_path_factory):
    """Write tables into a folder like those of the test data; returns the folder."""

    def make(**tables):
        folder = tmp_path_factory.mktemp("tables")
        for name, rows in tables.items():
            rows.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return make
