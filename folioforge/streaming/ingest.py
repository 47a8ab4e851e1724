"""Incremental ingestion: rows as they arrive, each handled once; late ones apart."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener


def new_files(spark: SparkSession, path: str, schema: T.StructType, *, max_files: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; with ``max_files``, no more than so many a batch, oldest first."""
    reader = spark.readStream.schema(schema)
    return (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).parquet(path)


def run_available(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append what is there to a Parquet folder and stop; progress is kept in checkpoint, so rows arrive once."""
    query = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


class _Batches(StreamingQueryListener):
    def __init__(self, watch: Watch):
        self.watch = watch

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if str(p.id) == self.watch.id and p.numInputRows:
            self.watch.batches.append({"batch": p.batchId, "rows": p.numInputRows, "ms": p.batchDuration})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if str(event.id) == self.watch.id:
            self.watch.failure = event.exception


@dataclass
class Watch:
    """A folder that is watched until it is told to stop: new files are appended to a table as they come.

    Progress is in ``checkpoint`` and the table's own log, so that a watch that was stopped or killed goes on where
    it was: files are read once and their rows written once. ``batches`` lists the batches that had rows.
    """

    source: str
    table: str
    checkpoint: str
    schema: T.StructType
    every: str = "10 seconds"
    max_files: int = 1000
    batches: list[dict] = field(default_factory=list)
    failure: str | None = None
    id: str = ""
    query: StreamingQuery | None = None
    listener: _Batches | None = None

    def start(self, spark: SparkSession) -> Watch:
        if self.query is not None and self.query.isActive:
            raise RuntimeError("already watching")
        if self.listener is None:  # stays with the session, so that batches of later starts are listed too
            self.listener = _Batches(self)
            spark.streams.addListener(self.listener)
        rows = new_files(spark, self.source, self.schema, max_files=self.max_files)
        self.query = rows.writeStream.format("parquet").option("path", self.table).option("checkpointLocation", self.checkpoint).trigger(processingTime=self.every).start()
        self.id = str(self.query.id)
        return self

    def caught_up(self) -> None:
        """Wait until all files that are there now are in the table."""
        if self.query is None:
            raise RuntimeError("not watching")
        self.query.processAllAvailable()

    def stop(self) -> None:
        """Stop after what is being written, or in the midst of it: either way nothing is lost or written twice."""
        if self.query is not None:
            self.query.stop()
            self.query = None


def windowed_counts(events: DataFrame, *, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events and their values by type in event-time windows; state for windows past the watermark is dropped."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("window.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def session_counts(events: DataFrame, *, gap: str = "30 minutes", late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """Sessions of each key: its rows no further apart than the gap, with their first and last time.

    On a stream a session is given out once the watermark has passed its end, and never again.
    """
    by = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.sum("value").alias("total"))
    return by.select(key, "first", "last", "n", F.round("total", 4).alias("total"))


def split_late(stream: DataFrame, folder: str, checkpoint: str, *, late_ms: int, time: str = "ts") -> StreamingQuery:
    """Rows that come later than ``late_ms`` after the newest row of earlier batches go to folder/late, others to
    folder/on_time; both are tables with a partition for each batch.

    This is the bound by which a watermark drops rows, so that a windowed query over on_time drops none.
    A batch that is run again writes its own partitions again and nothing else. The newest time of each batch stands in
    folder/newest.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = None
        if number:
            before = spark.read.schema("newest timestamp, batch int").parquet(f"{folder}/newest").filter(F.col("batch") < number)
            newest = before.agg(F.max("newest")).first()[0]
        rows = batch.persist()
        try:
            bound = F.lit(newest) - F.make_dt_interval(secs=F.lit(late_ms / 1000)) if newest is not None else F.lit(None).cast("timestamp")
            is_late = F.coalesce(F.col(time) < bound, F.lit(False))
            for name, part in (("on_time", rows.filter(~is_late)), ("late", rows.filter(is_late)), ("newest", rows.agg(F.max(time).alias("newest")))):
                part.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        finally:
            rows.unpersist()

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def deduplicated(stream: DataFrame, keys: list[str], time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """First row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def unseen(stream: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Rows of a stream whose key is not in a table of those done before."""
    return stream.join(processed.select(key).distinct(), key, "left_anti")


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table that a stream may not have begun yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
