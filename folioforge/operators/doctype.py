"""Document type model: imputed and scaled features, multinomial logistic regression with balanced classes.

A model is a saved pipeline, a card that says what it was trained on and how well it does, a snapshot of its
training rows, and an entry in the registry; predictions name every label's probability and the features that
weighed most.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.staging import staged

#: Labels in the order in which predictions list them and ties are decided.
MODEL_LABELS = ("TEXT_PDF", "IMAGE_OF_TEXT_PDF", "IMAGE_PDF", "MIXED_PDF")
#: Columns of a feature table that are never features.
NO_FEATURES = ("rel_path", "doc_id", "top_level_folder", "label_norm", "label_raw", "label", "pages_sampled", "dpi", "seed", "predicted_label", "confidence")


def feature_columns(df: DataFrame) -> list[str]:
    """The numeric columns of a table that a model may learn from, in order."""
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean")
    return [c for c, kind in df.dtypes if c not in NO_FEATURES and (kind in numeric or kind.startswith("decimal"))]


def _place(key: str, seed: int) -> Column:
    return F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"), 256)


def split(rows: DataFrame, label: str, key: str, share: float, seed: int) -> DataFrame:
    """rows with ``held_out``: of each class, the share with the smallest hash; a class of one stays in training.

    The hash's first digits deal a class to 65536 buckets, whose counts say in which the share ends: rows before it
    are held out, rows behind it not, and only those in it are ranked. No task sees all rows of a class.
    """
    hashed = rows.withColumn("__place", _place(key, seed))
    hashed = hashed.withColumn("__bucket", F.conv(F.substring("__place", 1, 4), 16, 10).cast("int"))
    each = Window.partitionBy(label).orderBy("__bucket")
    counts = hashed.groupBy(label, "__bucket").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(label))
    upto = counts.select(label, "__bucket", "n", F.sum("n").over(each).alias("upto"), F.when(total > 1, F.ceil(total * share)).otherwise(0).alias("wanted"))
    ends = upto.filter("wanted > 0 and upto >= wanted and upto - n < wanted").select(F.col(label).alias("__label"), F.col("__bucket").alias("__end"), (F.col("wanted") - F.col("upto") + F.col("n")).alias("__take"))
    marked = hashed.join(F.broadcast(ends), F.col(label).eqNullSafe(F.col("__label")), "left")  # a row for each class
    within = F.when(F.col("__bucket") == F.col("__end"), F.struct(label, F.lit(0))).otherwise(F.struct(label, F.col("__bucket") + 1))
    rank = F.row_number().over(Window.partitionBy(within).orderBy("__place", key))
    held = (F.col("__bucket") < F.col("__end")) | ((F.col("__bucket") == F.col("__end")) & (rank <= F.col("__take")))
    return marked.withColumn("held_out", F.coalesce(held, F.lit(False))).drop("__place", "__bucket", "__label", "__end", "__take")


def fit(rows: DataFrame, features: list[str], label: str = "label", iterations: int = 1000) -> PipelineModel:
    """A pipeline fitted on labelled rows; every class weighs the same."""
    counts = rows.groupBy(label).agg(F.count("*").alias("in_class"))
    total = Window.partitionBy()
    weights = counts.select(label, (F.sum("in_class").over(total) / (F.count("*").over(total) * F.col("in_class"))).alias("weight"))
    weighted = rows.join(F.broadcast(weights), label)  # a row for each class
    filled = [f"{f}_filled" for f in features]
    stages = [
        Imputer(strategy="median", inputCols=features, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="assembled"),
        StandardScaler(withMean=True, inputCol="assembled", outputCol="scaled"),
        StringIndexer(inputCol=label, outputCol="target", stringOrderType="alphabetAsc"),
        LogisticRegression(featuresCol="scaled", labelCol="target", weightCol="weight", family="multinomial", maxIter=iterations),
    ]
    return Pipeline(stages=stages).fit(weighted)


def _parts(model: PipelineModel) -> tuple[list[str], list[str], PipelineModel]:
    """(labels, features, the model without its label indexer)."""
    labels = next(list(s.labels) for s in model.stages if hasattr(s, "labels"))
    features = next(s.getInputCols() for s in model.stages if s.hasParam("inputCols") and s.hasParam("outputCols") and not hasattr(s, "labels"))
    return labels, list(features), PipelineModel([s for s in model.stages if not hasattr(s, "labels")])


def _reasons(model: PipelineModel, labels: list[str], features: list[str], n: int) -> Column:
    """The n features with the largest share in the predicted label's score, with their values, as JSON in falling order."""
    weights = model.stages[-1].coefficientMatrix.toArray().tolist()  # labels x features
    of_label = F.create_map(*(x for name, own in zip(labels, weights, strict=True) for x in (F.lit(name), F.array(*map(F.lit, own)))))
    own = F.coalesce(F.try_element_at(of_label, F.col("predicted_label")), F.array(*map(F.lit, weights[0])))
    parts = F.zip_with(own, vector_to_array("scaled"), lambda w, x: F.abs(w * x))
    names, values = F.array(*map(F.lit, features)), F.array(*(F.col(f).cast("double") for f in features))
    ranked = F.array_sort(F.transform(parts, lambda p, i: F.struct((-p).alias("rank"), i.alias("i"))))
    top = F.transform(F.slice(ranked, 1, n), lambda r: F.struct(F.element_at(names, r["i"] + 1).alias("key"), F.element_at(values, r["i"] + 1).alias("value")))
    return F.to_json(F.map_from_entries(top), {"ignoreNullFields": "false"})


def predict(model: PipelineModel, rows: DataFrame, keep: list[str], *, reasons: int = 0, known: tuple[str, ...] = MODEL_LABELS) -> DataFrame:
    """The kept columns, predicted_label, confidence and proba_ of each known label (0 for one never seen in training).

    The likeliest label wins, of equally likely ones the first. With ``reasons``, reason_features names so many features.
    """
    labels, features, without = _parts(model)
    p = vector_to_array("probability")
    probabilities = [(p[labels.index(k)] if k in labels else F.lit(0.0)).alias(f"proba_{k}") for k in known]
    shown = without.transform(rows).select("*", *probabilities)
    best = F.greatest(*(F.col(f"proba_{k}") for k in known))
    winner = F.coalesce(*(F.when(F.col(f"proba_{k}") == best, k) for k in known))
    named = shown.withColumn("predicted_label", winner).withColumn("confidence", best)
    out = [*keep, "predicted_label", "confidence", *(f"proba_{k}" for k in known)]
    return named.select(*out, *([_reasons(model, labels, features, reasons).alias("reason_features")] if reasons else []))


def evaluate(predictions: DataFrame, truth: str = "label") -> dict:
    """Accuracy, confusion matrix and precision, recall, F1 and support of each label of the held-out rows."""
    pairs = {(r[0], r[1]): r[2] for r in predictions.groupBy(truth, "predicted_label").count().collect()}  # labels x labels
    labels = sorted({a for a, _ in pairs})
    total = sum(pairs.values())
    if not total:
        return {"labels": [], "confusion_matrix": [], "classification_report": {}, "accuracy": None}
    report = {}
    for k in labels:
        hit, given, there = pairs.get((k, k), 0), sum(n for (_, p), n in pairs.items() if p == k), sum(n for (t, _), n in pairs.items() if t == k)
        report[k] = {"precision": hit / given if given else 0.0, "recall": hit / there, "f1-score": 2 * hit / (given + there), "support": there}
    matrix = [[pairs.get((a, b), 0) for b in labels] for a in labels]
    return {"labels": labels, "confusion_matrix": matrix, "classification_report": report, "accuracy": sum(pairs.get((k, k), 0) for k in labels) / total}


@dataclass(frozen=True)
class Trained:
    """A model with its card."""

    model: PipelineModel
    card: dict
    snapshot: DataFrame


def train(rows: DataFrame, features: list[str], *, key: str = "rel_path", share: float = 0.2, seed: int = 42, iterations: int = 1000, about: dict | None = None) -> Trained:
    """Split, fit and evaluate labelled rows (``label``); the card repeats what it was given in ``about``.

    Every stage of the pipeline reads the rows again: they are computed and split once, into a table.
    """
    halves = staged(split(rows.select(key, "label", *features), "label", key, share, seed), "halves")
    model = fit(halves.filter("not held_out"), features, iterations=iterations)
    result = evaluate(predict(model, halves.filter("held_out"), ["label"]))
    counts = {r["label"]: r["count"] for r in halves.groupBy("label").count().collect()}  # a row for each label
    card = {
        "timestamp": datetime.now(timezone.utc).isoformat(), "model_version": "doc_type_v1", "training_rows": sum(counts.values()), "label_distribution": counts, "features": features, "eval": result,
        "hyperparams": {"model": "LogisticRegression", "multi_class": "multinomial", "class_weight": "balanced", "imputer": "median", "scaler": "standard", "max_iter": iterations, "random_state": seed},
        **(about or {}),
    }
    return Trained(model, card, halves.select(key, F.col("label").alias("label_norm"), *features))


_REGISTRY = "model_id string, trained_at string, path string, card string"


def save(trained: Trained, root: str, model_id: str) -> str:
    """Write pipeline, card and training snapshot below root and enter the model in the registry; returns its path.

    A model id is used once; the registry is appended to, so the latest entry is what LATEST means.
    """
    spark = trained.snapshot.sparkSession
    path = f"{root}/models/doc_type/{model_id}"
    trained.model.write().save(f"{path}/model")
    trained.snapshot.write.parquet(f"{path}/training_snapshot")
    entry = [(model_id, trained.card["timestamp"], path, json.dumps(trained.card, sort_keys=True))]
    spark.createDataFrame(entry, _REGISTRY).coalesce(1).write.mode("append").parquet(f"{root}/models/doc_type/registry")
    return path


def registry(spark: SparkSession, root: str) -> DataFrame:
    """Models that were saved below root."""
    return spark.read.schema(_REGISTRY).parquet(f"{root}/models/doc_type/registry")


def load(spark: SparkSession, root: str, reference: str = "LATEST") -> tuple[PipelineModel, dict]:
    """(model, card) of the latest model, of a model id, or of a model's path."""
    found = registry(spark, root)
    if reference != "LATEST":
        found = found.filter((F.col("model_id") == reference) | (F.col("path") == reference.rstrip("/")))
    row = found.orderBy(F.desc("trained_at"), F.desc("model_id")).first()
    if row is None:
        raise FileNotFoundError(f"no document type model {reference} below {root}")
    return PipelineModel.load(f"{row['path']}/model"), json.loads(row["card"])
