import pytest


@pytest.fixture
def documents(spark):
    """A documents table from texts or (doc_id, text) pairs, with a clashing extra column or two."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        rows = [(i, t, "en", "src0", len(t or ""), 7, "x") for i, t in rows]
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, fp int, score string")

    return make


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) of the smallest documents."""
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t.column(0).to_pylist(), t.column(1).to_pylist()))
