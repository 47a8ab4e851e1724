"""Exports for readers outside Spark; metadata only, never page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: No exported string may be longer.
LONGEST = 300


def too_long(df: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Rows with a string column longer than exports allow."""
    out: Column = F.lit(False)
    for name, kind in df.dtypes:
        if kind == "string":
            out = out | (F.length(F.col(f"`{name}`")) > longest)
    return df.filter(out)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; refuses rows with long strings."""
    if not too_long(df).isEmpty():
        raise ValueError(f"a string of more than {LONGEST} characters is no metadata")
    df.write.json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for a filtered view."""
    df.coalesce(1).write.option("header", True).csv(path)


def run_index(runs: DataFrame) -> DataFrame:
    """The latest run of each stage for every source root, side by side."""
    latest = runs.groupBy("source_root", "stage").agg(F.max_by("run_id", F.struct("ts", "run_id")).alias("run_id"), F.max("ts").alias("ts"))
    cells = {s: F.max(F.when(F.col("stage") == s, F.col("run_id"))).alias(f"{s}_run") for s in ("inventory", "probe")}
    return latest.groupBy("source_root").agg(*cells.values(), F.max("ts").alias("updated_at"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    """The download manifest as one snapshot, in order of address; the one before is replaced."""
    manifest.orderBy("url").coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def catalog_json(index: DataFrame, meta: dict, path: str) -> None:
    """A public catalog for a browser: one line of facts on it, then a line for each item; refuses long strings."""
    import json

    spark = index.sparkSession
    if not too_long(index).isEmpty():
        raise ValueError(f"a string of more than {LONGEST} characters is no metadata")
    index.write.mode("overwrite").json(f"{path}/items")
    facts = meta | {"item_count": spark.read.schema(index.schema).json(f"{path}/items").count()}
    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
