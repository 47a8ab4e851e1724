"""Run bookkeeping and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge import staging
from folioforge.operators import catalogue_views as views
from folioforge.operators import incremental
from folioforge.plans.adapters import table
from folioforge.sources import export, tables
from folioforge.streaming import ingest

from .registry import query

def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs by day, root and stage, as events tell them; purchases know no time."""
    rows = table(spark, d, "events").select(F.col("ts"), (F.col("user_id") % 7).alias("u"), F.when(F.col("event_id") % 3 == 0, "inventory").when(F.col("event_id") % 3 == 1, "probe").otherwise("text-scan").alias("stage"), F.to_date("ts").alias("day"))
    found = rows.groupBy("stage", "u", "day").agg(F.max("ts").alias("ts"))
    dated = F.concat("stage", F.lit("_"), F.date_format("ts", "yyyyMMdd_HHmmss"))
    run_id = F.concat(F.lit("r"), "u", F.lit("_"), F.when(F.col("u") == 6, F.concat_ws("_", "stage", F.dayofyear("day").cast("string"))).otherwise(dated))
    return found.select("stage", run_id.alias("run_id"), F.concat(F.lit("/data/"), "u").alias("source_root"), F.when(F.col("u") != 6, F.col("ts")).alias("ts"))


_RUNS = """WITH e AS (SELECT ts, user_id % 7 AS u, CASE event_id % 3 WHEN 0 THEN 'inventory' WHEN 1 THEN 'probe' ELSE 'text-scan' END AS stage, ts::DATE AS day FROM events),
days AS (SELECT stage, u, day, max(ts) AS t FROM e GROUP BY ALL),
runs AS (SELECT stage, 'r' || u || '_' || stage || '_' || CASE WHEN u = 6 THEN dayofyear(day)::VARCHAR ELSE strftime(t, '%Y%m%d_%H%M%S') END AS run_id, '/data/' || u AS source_root, CASE WHEN u <> 6 THEN t END AS ts FROM days)
"""
query("run_catalog", _RUNS + """SELECT stage, run_id, source_root, ts, row_number() OVER (PARTITION BY stage
  ORDER BY ts DESC NULLS LAST, run_id)::INT AS place
  FROM runs""")(
    lambda s, d: incremental.run_catalog(_runs(s, d)),
)
query("latest_run", _RUNS + """SELECT stage, source_root, arg_max(run_id, (coalesce(ts, TIMESTAMP '1900-01-01'), run_id)) AS run_id, max(ts) AS ts
  FROM runs
  GROUP BY ALL""")(
    lambda s, d: incremental.latest_run(_runs(s, d)),
)


@query("ingest_available_now", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _ingest(s: SparkSession, d: str) -> DataFrame:
    """Events streamed once into a table, then counted."""
    base = f"{staging.working_folder(s)}/ingest/{uuid.uuid4().hex}"
    schema = table(s, d, "events").schema
    one = s.readStream.schema(schema).option("pathGlobFilter", "events*").parquet(d)
    ingest.run_available(one, f"{base}/table", f"{base}/progress").stop()
    return s.read.schema(schema).parquet(f"{base}/table").groupBy("event_type").agg(F.count("*").alias("n"))


query("windowed_event_counts", """SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total
  FROM events
  GROUP BY ALL""")(
    lambda s, d: ingest.windowed_counts(table(s, d, "events")),
)
query("run_index", _RUNS + """SELECT source_root, max(CASE WHEN stage = 'inventory' THEN r END) AS inventory_run, max(CASE WHEN stage = 'probe' THEN r END) AS probe_run, max(ts) AS updated_at
  FROM (SELECT source_root, stage, arg_max(run_id, (coalesce(ts, TIMESTAMP '1900-01-01'), run_id)) AS r, max(ts) AS ts
  FROM runs
  GROUP BY ALL)
  GROUP BY 1""")(
    lambda s, d: export.run_index(_runs(s, d)),
)
query(
    "run_date_labels",
    _RUNS
    + """SELECT run_id, CASE WHEN regexp_matches(run_id, '\\d{8}_\\d{6}') THEN regexp_replace(regexp_extract(run_id, '(\\d{8})_\\d{6}', 1), '(....)(..)(..)', '\\1-\\2-\\3') ELSE run_id END AS day
  FROM runs""",
)(lambda s, d: _runs(s, d).select("run_id", views.run_date_label(F.col("run_id")).alias("day")))


@query(
    "published_runs",
    _RUNS + """SELECT stage, 'newest' AS run_id, '/data' AS source_root, max(ts) AS ts, count(*) AS rows, 1::BIGINT AS records FROM runs GROUP BY stage""",
)
def _published(s: SparkSession, d: str) -> DataFrame:
    """The runs of each stage as the table of one run, published twice: the second time adds nothing."""
    root, found = f"{staging.working_folder(s)}/published/{uuid.uuid4().hex}", _runs(s, d)
    for stage in ("inventory", "probe", "text-scan"):
        rows = found.filter(F.col("stage") == stage)
        newest = rows.agg(F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).first()[0]
        if newest is not None:
            for _ in range(2):
                tables.write_run(rows.drop("stage"), root, stage, "newest", "/data", newest)
    records = tables.runs(s, root)
    held = s.read.parquet(f"{root}/*/run_id=newest").withColumn("stage", F.regexp_extract(F.input_file_name(), "([^/]+)/run_id=newest/", 1))
    counts = held.groupBy("stage").agg(F.count("*").alias("rows"))
    times = records.groupBy("stage", "run_id", "source_root").agg(F.max("ts").cast(found.schema["ts"].dataType).alias("ts"), F.count("*").alias("records"))
    return times.join(counts, "stage").select("stage", "run_id", "source_root", "ts", "rows", "records")
