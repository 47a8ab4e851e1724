"""Intermediate tables and stream progress in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def working_folder(spark: SparkSession) -> str:
    """The shared folder for progress and intermediate tables: spark.checkpoint.dir, else one in the warehouse.

    A warehouse on a machine's own disk is no shared folder, so that it serves a local session only.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/folioforge"
        if found.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("executors need a shared folder: set spark.checkpoint.dir")
    return found.rstrip("/")


_STAGED: list[tuple[SparkSession, str]] = []


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: computed once, and not again when an executor is lost.

    The table goes when the process ends.
    """
    spark = df.sparkSession
    path = f"{working_folder(spark)}/staged/{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    _STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _drop_staged() -> None:
    for spark, path in _STAGED:
        with contextlib.suppress(Exception):  # the session may be gone, and its folder with it
            target = spark._jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
