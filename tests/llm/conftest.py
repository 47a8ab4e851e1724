import pytest


@pytest.fixture
def frame(spark):
    """documents with the given (doc_id, text) rows, and columns whose names operators use inside."""

    def make(rows, partitions=2):
        schema = "doc_id long, text string, class string, gram string, part string, rank string, n string, score string, learn string, shard string"
        return spark.createDataFrame([(i, t, *["x"] * 8) for i, t in rows], schema).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def documents(spark):
    from tests.conftest import TABLES

    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "two words"), (6, "word " * 30_000), (7, "é" * 50_000), (8, "A@b.c 1.2.3.4 ünïcödé, the MIT license!")]
