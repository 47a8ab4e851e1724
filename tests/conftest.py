import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {name} as select * from '{TABLES}/{name}.parquet'")
    return con


def normal(value) -> str:
    if value is None or value != value:
        return "NULL"
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return value.isoformat()[:19] if hasattr(value, "isoformat") else str(value)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Whether a query and its SQL give the same columns and rows."""

    def check(query, oracle: str) -> None:
        frame, relation = query(spark, TABLES), duck.sql(oracle)
        columns = sorted(relation.columns)
        assert sorted(frame.columns) == columns
        at = [relation.columns.index(c) for c in columns]
        expected = sorted(tuple(normal(row[i]) for i in at) for row in relation.fetchall())
        assert sorted(tuple(normal(row[c]) for c in columns) for row in frame.collect()) == expected

    return check
