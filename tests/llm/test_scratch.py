import threading
from concurrent.futures import ThreadPoolExecutor

import pytest

from folioforge.llm import scratch


class Context:
    def __init__(self, master, checkpoints=None):
        self.master, self.checkpoints = master, checkpoints

    def getConf(self):  # noqa: N802
        return {"spark.checkpoint.dir": self.checkpoints}

    def getCheckpointDir(self):  # noqa: N802
        return None


class Session:
    def __init__(self, context):
        self.sparkContext, self.conf = context, {"spark.sql.warehouse.dir": "file:/here/spark-warehouse"}  # noqa: N815


def test_a_shared_folder_is_needed_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session(Context("spark://somewhere")))
    assert scratch.shared_dir(Session(Context("local[2]"))) == "file:/here/spark-warehouse/folioforge"
    assert scratch.shared_dir(Session(Context("spark://somewhere", "hdfs://shared/"))) == "hdfs://shared"


def test_operators_beside_each_other_keep_their_tables(spark):
    """One operator ends, and deletes its tables, while another is still at work on its own."""
    written, ended = threading.Event(), threading.Event()

    @scratch.only_result
    def slow():
        table = scratch.materialise(spark.range(5), "slow")
        written.set()
        assert ended.wait(60)
        return table

    @scratch.only_result
    def quick():
        assert written.wait(60)
        return scratch.materialise(spark.range(3), "quick")

    with ThreadPoolExecutor(2) as pool:
        one, other = pool.submit(slow), pool.submit(quick)
        assert other.result(60).count() == 3
        ended.set()
        assert one.result(60).count() == 5
