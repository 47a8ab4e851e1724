"""Change detection over a stream of addresses, with what is known of each address as state.

Each address has one state: what it was like when it was last seen. A row that arrives is compared with it and
entered in it, so that a batch costs what it brings and not what is known. An address that is not seen for a while
is reported as gone when event time has passed that long. State is kept in RocksDB below the query's checkpoint;
no manifest is rewritten.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

_KNOWN = "etag string, last_modified string, content_length long, seen_at timestamp"
STATUSES = "url string, seen_at timestamp, status string"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _filled(value) -> bool:
    return value is not None and value == value and str(value) != ""


def _status(now, known: tuple | None) -> str:
    """By which rule an address is unchanged, or that it is new or changed."""
    if _filled(now.status_code) and int(now.status_code) == 304:
        return "skipped_304"
    if known is None:
        return "new"
    for rule, own, before in (("skipped_etag", now.etag, known[0]), ("skipped_last_modified", now.last_modified, known[1]), ("skipped_length", now.content_length, known[2])):
        if _filled(own) and _filled(before) and own == before:
            return rule
    return "changed"


class Changes(StatefulProcessor):
    """One address: rows in order of time, each judged by the state that the one before left."""

    def __init__(self, gone_after_ms: int | None):
        self.gone_after_ms = gone_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", _KNOWN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = list(rows)
        arrived = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        if len(arrived) > 1:
            arrived = arrived.sort_values("seen_at", kind="stable")
        state = self.known.get()  # one call for each address: none if nothing is known
        known = None if state is None else tuple(state)
        out = []
        for now in arrived.itertuples(index=False):
            out.append((key[0], now.seen_at, _status(now, known)))
            own = (now.etag, now.last_modified, None if not _filled(now.content_length) else int(now.content_length))
            old = known or (None, None, None)
            known = (*(o if _filled(o) else b for o, b in zip(own, old, strict=False)), now.seen_at.to_pydatetime())
        if known is not None:
            self.known.update(known)
        if self.gone_after_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(int(arrived["seen_at"].max().timestamp() * 1000) + self.gone_after_ms)
        yield pd.DataFrame(out, columns=["url", "seen_at", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.known.get()[3] if self.known.exists() else None
        self.known.clear()
        yield pd.DataFrame({"url": [key[0]], "seen_at": [pd.Timestamp(last)], "status": ["gone"]})

    def close(self) -> None:
        pass


def detect_changes(stream: DataFrame, *, late: str = "1 hour", gone_after_ms: int | None = None) -> DataFrame:
    """stream: url, etag, last_modified, content_length, status_code and seen_at -> url, seen_at and status of each row.

    Rows of one address and batch are judged in order of seen_at. With ``gone_after_ms``, an address not seen for so
    long is reported as gone and forgotten; rows later than the watermark are then left out. A null address is none.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    rows = stream.filter("url is not null").select("url", "etag", "last_modified", F.col("content_length").cast("long").alias("content_length"), F.col("status_code").cast("int").alias("status_code"), "seen_at")
    timed = gone_after_ms is not None
    if timed:
        rows = rows.withWatermark("seen_at", late)
    return rows.groupBy("url").transformWithStateInPandas(Changes(gone_after_ms), outputStructType=STATUSES, outputMode="append", timeMode="eventTime" if timed else "none")


def follow_changes(stream: DataFrame, table: str, checkpoint: str, **options) -> StreamingQuery:
    """Statuses of what is there, appended to a table; the next call goes on from the state that this one left."""
    query = detect_changes(stream, **options).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def known_addresses(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What the state holds of each address, read from the checkpoint: the manifest, without a table of its own."""
    found = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "known").load()
    return found.select("key.url", "value.*")
