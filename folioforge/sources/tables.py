"""Versioned runs: tables, run records, summaries and the latest pointer; and loaders for tables made elsewhere."""

from __future__ import annotations

import io
import json
import uuid

import pyarrow as pa
import pyarrow.csv
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.functions import paths
from folioforge.operators import labels as label_rules
from folioforge.operators.incremental import latest_run
from folioforge.schemas import INVENTORY, LABELS, RUNS, ensure_columns


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = _path(spark, path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file through Spark's file systems, replacing one of that name."""
    target = _path(spark, path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str) -> dict:
    """A small JSON object; missing or broken ones are empty."""
    try:
        rows = spark.read.text(path, wholetext=True).collect()  # one file
        found = json.loads(rows[0][0]) if rows else {}
    except (AnalysisException, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def write_json(spark: SparkSession, path: str, data: dict) -> None:
    write_text(spark, path, json.dumps(data, indent=2, sort_keys=True))


def _rename(spark: SparkSession, source: str, target: str) -> None:
    """Give a folder or file a name that must be free; in one step, where the file system has one."""
    path, to = _path(spark, source), _path(spark, target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    options = spark._sc._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration())
    fs.mkdirs(to.getParent())
    context.rename(fs.makeQualified(path), fs.makeQualified(to), options)


def _record_path(root: str, stage: str, run_id: str) -> str:
    return f"{root}/runs/{stage}__{run_id}.json"


def write_run(df: DataFrame, root: str, stage: str, run_id: str, source_root: str, ts: str, *, summary: dict | None = None, log: dict | None = None, flat_copy: bool = False) -> str:
    """Write a table as one run of a stage and publish it; returns its path.

    The table is written under a hidden name and renamed when it is whole; then its record is entered under the run's
    own name, which publishes it: ``runs`` and readers of the latest run see recorded runs only. Whatever step fails,
    the same call again ends with one table and one record: a table that is there is not written again, a run
    that is recorded stays as it is. Beside the table: summary.json and run_log.json where given, LATEST.json in the
    stage's folder, and, if asked for, a flat CSV copy of the latest table for readers that know no runs.
    """
    spark = df.sparkSession
    path = f"{root}/{stage}/run_id={run_id}"
    if exists(spark, _record_path(root, stage, run_id)):
        return path
    if not exists(spark, path):
        hidden = f"{root}/{stage}/.writing_{run_id}_{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(hidden)
        _rename(spark, hidden, path)
    about = {"run_id": run_id, "timestamp": ts, "source_root": source_root}
    for name, data in (("summary", summary), ("run_log", log)):
        if data is not None:
            write_json(spark, f"{root}/{stage}/{run_id}.{name}.json", data | about)
    if flat_copy:
        plain = [c for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct", "binary"))]
        spark.read.schema(df.schema).parquet(path).select(*plain).write.mode("overwrite").option("header", True).csv(f"{root}/{stage}_latest_csv")
    record = {"stage": stage, "run_id": run_id, "source_root": source_root, "ts": ts, "path": path}
    hidden = f"{root}/runs/.{uuid.uuid4().hex}"
    write_text(spark, hidden, json.dumps(record, sort_keys=True))
    _rename(spark, hidden, _record_path(root, stage, run_id))
    write_json(spark, f"{root}/{stage}/LATEST.json", about | {"path": path})
    return path


def runs(spark: SparkSession, root: str) -> DataFrame:
    """The runs that are published: one record each."""
    rows = spark.read.schema("stage string, run_id string, source_root string, ts string, path string").json(f"{root}/runs")
    return rows.select("stage", "run_id", "source_root", F.col("ts").try_cast("timestamp").alias("ts"), "path").select(*RUNS.names)


def resolve_run(spark: SparkSession, root: str, stage: str, reference: str | None = None) -> str:
    """The path of a run: of an id or a path given, or the latest of the stage."""
    if reference and reference != "LATEST":
        path = f"{root}/{stage}/run_id={reference}"
        return path if exists(spark, path) else reference
    found = latest_run(runs(spark, root).filter(F.col("stage") == stage)).orderBy(F.desc("ts"), F.desc("run_id")).first() if exists(spark, f"{root}/runs") else None
    if found is None:
        raise FileNotFoundError(f"no run of {stage} below {root}")
    return f"{root}/{stage}/run_id={found['run_id']}"


def read_run(spark: SparkSession, root: str, stage: str, schema: T.StructType, run_id: str | None = None) -> DataFrame:
    """A run's table under a fixed schema; without an id, the latest."""
    return ensure_columns(spark.read.parquet(resolve_run(spark, root, stage, run_id)), schema)


def load_run(spark: SparkSession, root: str, stage: str, run_id: str) -> tuple[DataFrame, dict, dict]:
    """(table, summary, run log) of one run; what is missing is empty."""
    table = spark.read.parquet(resolve_run(spark, root, stage, run_id))
    return table, read_json(spark, f"{root}/{stage}/{run_id}.summary.json"), read_json(spark, f"{root}/{stage}/{run_id}.run_log.json")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV table by its header: all columns are read as text, then cast; what cannot be cast is null."""
    return ensure_columns(spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path), schema)


def read_csv_bytes(spark: SparkSession, content: bytes, schema: T.StructType) -> DataFrame:
    """A CSV table that is held in memory, such as an uploaded one."""
    text = pa.csv.ConvertOptions(column_types={}, strings_can_be_null=False)
    header = pa.csv.read_csv(io.BytesIO(content), convert_options=text).column_names if content.strip() else []
    if not header:
        return spark.createDataFrame([], schema)
    text = pa.csv.ConvertOptions(column_types={c: pa.string() for c in header}, strings_can_be_null=False)
    return ensure_columns(spark.createDataFrame(pa.csv.read_csv(io.BytesIO(content), convert_options=text)), schema)


def load_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table by its path, with or without ending: Parquet, else CSV, else an empty one."""
    parquet = [path] if path.endswith(".parquet") else [f"{path}.parquet", *([] if path.endswith(".csv") else [path])]
    for found in parquet:
        if exists(spark, found):
            try:
                return ensure_columns(spark.read.parquet(found), schema)
            except AnalysisException:  # no Parquet there
                continue
    for found in (path, f"{path}.csv"):
        if found.endswith(".csv") and exists(spark, found):
            return read_csv(spark, found, schema)
    return spark.createDataFrame([], schema)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, newest_by: str | None = None) -> DataFrame:
    """JSON lines; broken ones are left out. With ``newest_by``, in falling order of that column."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows if newest_by is None else rows.orderBy(F.desc_nulls_last(newest_by))


def load_inventory(df: DataFrame) -> DataFrame:
    """An inventory table made fit for labelling: normalized paths, small extensions, folders where they are missing."""
    rows = ensure_columns(df, INVENTORY).withColumn("rel_path", paths.normalize_rel_path(F.col("rel_path")))
    folder = F.coalesce(F.nullif(F.trim("top_level_folder"), F.lit("")), paths.top_level_folder(F.col("rel_path")))
    ext = F.regexp_replace(F.lower(F.coalesce(F.nullif(F.trim("extension"), F.lit("")), paths.extension(F.col("rel_path")))), r"^\.", "")
    return rows.withColumns({"top_level_folder": folder, "extension": ext})


def load_labels(df: DataFrame, inventory: DataFrame) -> DataFrame:
    """A label table of any age under the present schema: missing columns, labels under their old name, normalized
    labels, and blank paths recovered from the document's id or hash.
    """
    old = df.withColumn("label_raw", F.coalesce("label_raw", "label")) if {"label", "label_raw"} <= {*df.columns} else df.withColumnRenamed("label", "label_raw") if "label_raw" not in df.columns and "label" in df.columns else df
    rows = ensure_columns(old, LABELS).withColumn("label_id", F.monotonically_increasing_id())
    texts = [f.name for f in LABELS if f.name not in ("label_norm",)]
    rows = rows.select("label_id", *(F.coalesce(c, F.lit("")).alias(c) for c in texts))
    files = inventory if "doc_id" in inventory.columns else inventory.withColumn("doc_id", paths.stable_doc_id(F.lit(""), F.col("rel_path"), F.col("size_bytes"), F.col("modified_time")))
    found = label_rules.recover_paths(rows, files)
    path = paths.normalize_rel_path(F.col("rel_path")).alias("rel_path")
    kept = [c for c in texts if c not in ("rel_path", "label_raw", "labeled_at", "doc_id_at_label_time", "sha256_at_label_time")]
    norm = label_rules.normalize_label(F.col("label_raw")).alias("label_norm")
    return found.join(rows.select("label_id", *kept), "label_id").select(path, "label_raw", norm, *(c for c in texts if c not in ("rel_path", "label_raw")))


def upgrade_labels(df: DataFrame, path: str, backup: str) -> None:
    """Write an upgraded label table to ``path``; what stands there now goes to ``backup`` first."""
    spark = df.sparkSession
    if exists(spark, path):
        spark.read.parquet(path).write.mode("errorifexists").parquet(backup)
        kept = df.schema
        df.write.mode("errorifexists").parquet(f"{backup}_new")  # df may read from path
        df = spark.read.schema(kept).parquet(f"{backup}_new")
    df.write.mode("overwrite").parquet(path)


def inventory_identity(spark: SparkSession, path: str) -> str:
    """What an inventory file is known by: the run of its log, its run folder, its content's hash, or its path."""
    folder = path.rstrip("/").rpartition("/")[0]
    log = read_json(spark, f"{folder}/run_log.json") if folder else {}
    if log.get("inventory_run_id"):
        return str(log["inventory_run_id"])
    parts = path.rstrip("/").split("/")
    if len(parts) >= 3 and parts[-1] == "inventory.csv" and parts[-3] == "inventory":
        return parts[-2]
    if exists(spark, path):
        row = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).first()
        if row is not None:
            return f"hash:{row['h']}"
    return path


def infer_source_root(spark: SparkSession, path: str) -> tuple[str, str]:
    """(root, name) that an inventory was made of: from its run log, then its summary, then its own path."""
    folder = path.rstrip("/").rpartition("/")[0]
    log, summary = read_json(spark, f"{folder}/run_log.json"), read_json(spark, f"{folder}/inventory_summary.json")
    root = log.get("root") or path
    return root, log.get("source_root_name") or summary.get("source_root_name") or root.rstrip("/").rpartition("/")[2]


def prepare_folders(spark: SparkSession, root: str) -> dict[str, str]:
    """Make the folders that stages write to; returns them by name."""
    found = {"outputs": root} | {name: f"{root}/{at}" for name, at in (("inventory", "inventory"), ("probe", "probe"), ("labels", "labels"), ("models", "models/doc_type"), ("classification", "classification/doc_type"))}
    for at in found.values():
        target = _path(spark, at)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)
    return found
