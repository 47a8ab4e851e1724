"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import functools
import gc
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

class _Written(threading.local):
    """Tables that this thread wrote: operators that run beside each other leave each other's alone."""

    def __init__(self) -> None:
        self.tables: list[tuple[SparkSession, str]] = []
        _LISTS.append(self.tables)


_LISTS: list[list[tuple[SparkSession, str]]] = []
_WRITTEN = _Written()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, one in the warehouse.

    A warehouse on a machine's own disk is no shared folder, so that it serves a local session only.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/folioforge"
        if found.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("executors need a shared folder: set spark.checkpoint.dir")
    return found.rstrip("/")


def materialise(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage: whatever a task numbered (partition ids, running ranks) stays fixed when an
    executor is lost later on, because the numbers are read, never computed again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioforge/{uuid.uuid4().hex}/{label}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    _WRITTEN.tables.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(since: int = 0, tables: list[tuple[SparkSession, str]] | None = None) -> None:
    """Delete the intermediate tables that this thread (or the one of the list given) wrote, or those after the first ``since``."""
    tables = _WRITTEN.tables if tables is None else tables
    while len(tables) > since:
        spark, path = tables.pop()
        with contextlib.suppress(Exception):  # the session may be gone, and its folder with it
            target = spark._jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release_all() -> None:
    for tables in _LISTS:
        release(tables=tables)


def only_result(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose result is written and whose other tables go as soon as that is done.

    For results that are small beside what led to them: a long session's disk then holds results only.
    """

    @functools.wraps(operator)
    def run(*args, **options) -> DataFrame:
        before = len(_WRITTEN.tables)
        result = materialise(operator(*args, **options), "result")
        kept = _WRITTEN.tables.pop()
        release(before)
        _WRITTEN.tables.append(kept)
        return result

    return run


def smallest(rows: DataFrame, place: str, n: int) -> DataFrame:
    """The at most n rows with the smallest 64-bit hash in ``place``, in that order.

    A bound on the hash comes first, from the number of rows, so that one task meets little more than n of them
    however many tasks there are; should the bound have cut off too many, it is doubled. rows are read for each try.
    """
    total, expected = rows.count(), 1.5 * n + 100
    while expected < total:
        near = rows.filter(F.col(place) < F.lit(int(-(2**63) + expected / total * 2**64)))
        if near.count() >= n:
            return near.orderBy(place).limit(n)
        expected *= 2
    return rows.orderBy(place).limit(n)


atexit.register(release_all)


def drop_spent_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more.

    The cleaner acts when the driver's garbage is collected, which may be long after the files stopped
    being useful; multi-pass operators call this between passes so that disk holds one pass at a time. The
    session keeps hold of its latest plan, so a trivial one takes that place first.
    """
    spark.range(1).count()
    gc.collect()
    spark._jvm.System.gc()
