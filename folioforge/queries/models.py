"""The document type model: training, its life on disk, and predictions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge import staging
from folioforge.functions import paths
from folioforge.operators import doctype, labels, raster
from folioforge.plans.adapters import table, with_tables
from folioforge.sources import tables

from .media import features
from .readiness import ready_docs
from .registry import query


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Features of all PDFs, with labels where people gave them."""
    docs = ready_docs(spark, d).withColumn("top_level_folder", paths.top_level_folder(F.col("rel_path"))).filter(F.col("rel_path").endswith(".pdf"))
    raw = F.when(F.col("toxic") == 1, "MIXED_PDF").when(F.col("quality") == 1, "TEXT_PDF").otherwise("IMAGE_PDF")
    truth = table(spark, d, "labels").groupBy("doc_id").agg(F.max(labels.normalize_label(raw)).alias("label"))
    rows = raster.with_probe_metrics(features(spark, d), docs).join(docs.select("doc_id", "rel_path", "top_level_folder"), "doc_id")
    return rows.join(truth, "doc_id", "left")


def _names(rows: DataFrame) -> list[str]:
    """What a model may learn from, without what no probe measured."""
    return [c for c in doctype.feature_columns(rows.select(*raster.feature_names())) if c != "mostly_black_pct"]


def _trained(spark: SparkSession, d: str) -> tuple[doctype.Trained, DataFrame]:
    rows = staging.staged(_rows(spark, d), "features")  # cut and measured once: training and predictions read them many times
    labelled = labels.training_rows(rows.filter("label is not null").withColumnRenamed("label", "label_raw")).withColumnRenamed("label_norm", "label")
    return doctype.train(labelled, _names(rows), share=0.25, seed=7, iterations=40), rows


@query("doc_type_model")
def _predicted(spark: SparkSession, d: str) -> DataFrame:
    """Every PDF's type, with the probability of each and the features that weighed most."""
    trained, rows = _trained(spark, d)
    return doctype.predict(trained.model, rows, ["rel_path", "doc_id", "top_level_folder"], reasons=5)


@query(
    "doc_type_model_reloaded",
    with_tables("docs", "pages") + "SELECT count(DISTINCT doc_id) AS pdfs, 0::BIGINT AS differing, true AS same_features FROM pages WHERE rel_path LIKE '%.pdf'",
)
def _reloaded(spark: SparkSession, d: str) -> DataFrame:
    """A model saved and loaded again by LATEST: how many predictions differ from the first one's."""
    trained, rows = _trained(spark, d)
    root = f"{staging.working_folder(spark)}/models/{uuid.uuid4().hex}"
    doctype.save(trained, root, "m1_doc_type_20240101_000000")
    model, card = doctype.load(spark, root)
    first, second = (doctype.predict(m, rows, ["rel_path"]).select("rel_path", "predicted_label", F.round("confidence", 9).alias("confidence")) for m in (trained.model, model))
    differing = first.exceptAll(second)
    same = F.lit(card["features"] == trained.card["features"] and card["training_rows"] == trained.snapshot.count())
    return first.agg(F.count("*").alias("pdfs")).crossJoin(differing.agg(F.count("*").alias("differing"))).select("pdfs", "differing", same.alias("same_features"))  # one row each


@query(
    "doc_type_training_rows",
    with_tables("docs", "pages")
    + """, l AS (SELECT doc_id, CASE WHEN max(toxic) = 1 THEN 'MIXED_PDF' WHEN max(quality) = 1 THEN 'IMAGE_OF_TEXT_PDF' ELSE 'IMAGE_PDF' END AS label_norm FROM labels GROUP BY 1)
SELECT rel_path, label_norm FROM l JOIN docs USING (doc_id) WHERE rel_path LIKE '%.pdf' AND doc_id IN (SELECT doc_id FROM pages)""",
)
def _snapshot(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).filter("label is not null")
    return doctype.Trained(None, {}, rows.select("rel_path", F.col("label").alias("label_norm"))).snapshot
