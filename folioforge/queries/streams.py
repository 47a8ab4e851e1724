"""Streams: changes with state, a watched folder, late rows and sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge import staging
from folioforge.plans.adapters import table
from folioforge.streaming import changes, ingest

from .links import DIFF, current, manifest
from .registry import query


def _base(spark: SparkSession) -> str:
    return f"{staging.working_folder(spark)}/streams/{uuid.uuid4().hex}"


_SEEN = ("url", "etag", "last_modified", "content_length", "status_code", "seen_at")


def _followed(spark: SparkSession, d: str) -> str:
    """Addresses as they were on one day and on the next, streamed one day after the other; returns where all is."""
    base = _base(spark)
    days = ((manifest(spark, d).withColumn("status_code", F.lit(200)), "2024-01-01"), (current(spark, d), "2024-01-02"))
    for rows, day in days:
        seen = rows.withColumn("seen_at", F.lit(day).cast("timestamp")).select(*_SEEN)
        seen.write.mode("append").parquet(f"{base}/seen")
        changes.follow_changes(ingest.new_files(spark, f"{base}/seen", seen.schema), f"{base}/statuses", f"{base}/progress")
    return base


query("streamed_changes", DIFF + "SELECT url, status FROM diff")(
    lambda s, d: s.read.schema(changes.STATUSES).parquet(f"{_followed(s, d)}/statuses").filter("seen_at = '2024-01-02'").select("url", "status"),
)
query("streamed_manifest", DIFF + "SELECT url, coalesce(etag, e2) AS etag, coalesce(lm, l2) AS last_modified, n AS content_length FROM diff")(
    lambda s, d: changes.known_addresses(s, f"{_followed(s, d)}/progress").drop("seen_at"),
)


@query("watched_events", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS events FROM events GROUP BY 1")
def _watched(spark: SparkSession, d: str) -> DataFrame:
    """Events that arrive in files while their folder is watched, the watch being stopped and started again in between."""
    base, events = _base(spark), table(spark, d, "events")
    events.filter("event_id % 3 = 0").write.mode("append").parquet(f"{base}/in")
    watch = ingest.Watch(f"{base}/in", f"{base}/table", f"{base}/progress", events.schema, every="0 seconds", max_files=2).start(spark)
    events.filter("event_id % 3 = 1").repartition(3).write.mode("append").parquet(f"{base}/in")
    watch.stop()  # wherever it is
    events.filter("event_id % 3 = 2").repartition(2).write.mode("append").parquet(f"{base}/in")
    watch.start(spark).caught_up()
    watch.stop()
    return spark.read.schema(events.schema).parquet(f"{base}/table").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"))


#: Events come in four lots, which overlap in time; what is a week older than the newest of earlier lots is late.
_LOTS, _LATE_DAYS = 4, 7


def _split(spark: SparkSession, d: str) -> str:
    base, events = _base(spark), table(spark, d, "events")
    for lot in range(_LOTS):
        events.filter(F.col("event_id") % _LOTS == lot).write.mode("append").parquet(f"{base}/in")
        ingest.split_late(ingest.new_files(spark, f"{base}/in", events.schema), base, f"{base}/split", late_ms=_LATE_DAYS * 86_400_000)
    return base


_LOTS_SQL = f"""WITH lots AS (SELECT *, event_id % {_LOTS} AS lot FROM events),
bounds AS (SELECT a.lot, max(b.newest) - INTERVAL {_LATE_DAYS} DAY AS bound FROM (SELECT DISTINCT lot FROM lots) a LEFT JOIN (SELECT lot, max(ts) AS newest FROM lots GROUP BY 1) b ON b.lot < a.lot GROUP BY 1),
split AS (SELECT lots.*, coalesce(ts < bound, false) AS late FROM lots JOIN bounds USING (lot))
"""
query("late_events", _LOTS_SQL + "SELECT event_id, lot::INT AS batch FROM split WHERE late")(
    lambda s, d: s.read.schema("event_id long, batch int").parquet(f"{_split(s, d)}/late").select("event_id", "batch"),
)


@query(
    "event_sessions",
    _LOTS_SQL
    + """, marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS begins FROM split WHERE NOT late WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
islands AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM marked)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n, round(sum(value), 4) AS total FROM islands GROUP BY user_id, island""",
)
def _sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users over the stream of rows that are not late, given out as the watermark passes them."""
    base, schema = _split(spark, d), table(spark, d, "events").schema
    on_time = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/on_time").withColumn("ts", F.col("ts").cast("timestamp"))

    def run() -> None:
        ingest.run_available(ingest.session_counts(on_time, gap="6 hours", late=f"{_LATE_DAYS} days"), f"{base}/sessions", f"{base}/progress")

    run()
    last = table(spark, d, "events").limit(1).withColumns({"ts": F.lit("2100-01-01").cast(schema["ts"].dataType), "user_id": F.lit(-1).cast(schema["user_id"].dataType)})
    last.select(*schema.names).write.parquet(f"{base}/on_time/batch={_LOTS}")  # time goes on, so that all sessions end
    run()
    found = ingest.read_or_empty(spark, f"{base}/sessions", ingest.session_counts(on_time).schema)
    return found.withColumns({c: F.col(c).cast(schema["ts"].dataType) for c in ("first", "last")})
