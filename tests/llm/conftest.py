import pytest
from samples import EXTRA, SCHEMA, prose

@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows."""
    shared = "a line of more than forty characters that very many documents hold."
    rows = [(i, prose(i, 60 + i) + "\n" + shared, "en", f"src{i % 3}", None) for i in range(12)]
    rows += [(50, None, None, None, None), (51, "", "en", "src0", 0), (52, " \n\t ", "en", None, 5), (None, prose(3, 80), "en", "src1", None), (None, None, None, None, None)]
    rows += [(60, prose(60, 9000), "en", "src0", None), (61, "x" * 30000, "de", "src2", None), (62, "é世\x00\x1c🙂 " * 50, "fr", "src2", None)]
    rows += [(70, prose(5, 65) + "\n" + shared, "en", "src0", None)] * 2 + [(71, prose(5, 65) + "\n" + shared, "en", "src0", None), (72, "of of of of " * 40, "en", "src1", None)]
    return [(*r, *EXTRA) for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}
