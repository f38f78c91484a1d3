import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def pairs(docs):
    """(doc_id, text) of all documents."""
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def table(spark):
    """Documents of (id, text), with further columns whose names the operators use themselves."""
    def make(rows):
        return spark.createDataFrame(
            [(i, t, "x", 1, 2, "k") for i, t in rows],
            "doc_id long, text string, hash string, n_words int, h1 int, row_key string")
    return make
