"""Human labels, decisions, and what is labelled next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge import staging
from folioforge.functions import paths
from folioforge.operators import labels, readiness
from folioforge.plans import adapters
from folioforge.plans import reference_sql as sql
from folioforge.plans.adapters import table, with_tables

from folioforge.sources.keyed import KeyedTable

from .readiness import ready_docs
from .registry import query


def _inventory(spark: SparkSession, d: str) -> DataFrame:
    """The inventory, with second files of some paths: tables are also listed below ".", images with backslashes."""
    inv = adapters.inventory(spark, d)
    tables = inv.filter("extension = 'csv'").withColumns({"rel_path": F.concat(F.lit("./"), "rel_path"), "top_level_folder": F.lit(".")})
    images = inv.filter("extension = 'jpg'").withColumn("rel_path", F.translate("rel_path", "/", "\\"))
    return inv.unionByName(tables).unionByName(images)


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels made from the label table: with backslashes, moved paths and blank ones; toxic rows are there twice."""
    rows = table(spark, d, "labels").join(adapters.documents(spark, d).select("doc_id", "rel_path", F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "doc_id")
    odd = [F.pmod("doc_id", F.lit(n)) for n in (2, 3, 7, 11)]
    path = F.when(odd[3] == 0, "").when(odd[2] == 0, F.concat(F.lit("moved/"), "rel_path")).when(odd[0] == 1, F.translate("rel_path", "/", "\\")).otherwise(F.col("rel_path"))
    raw = F.when(F.col("toxic") == 1, "MIXED_PDF").when(F.col("quality") == 1, "TEXT_PDF").otherwise("image_pdf")
    then = F.when(odd[1] == 0, F.col("doc_id").cast("string")).when(odd[1] == 1, "").otherwise("-5")
    once = rows.select(F.col("doc_id").alias("label_id"), path.alias("rel_path"), raw.alias("label_raw"), F.lit("2024-01-01").alias("labeled_at"), then.alias("doc_id_at_label_time"), F.when(odd[0] == 0, F.col("sha")).otherwise("").alias("sha256_at_label_time"))
    return once.unionByName(once.filter("label_raw = 'MIXED_PDF'"))


_LAB = (
    with_tables("docs", "inv")
    + """, inv2 AS (
  SELECT doc_id, rel_path, top_level_folder, extension, hash_value FROM inv
  UNION ALL SELECT doc_id, './' || rel_path, '.', extension, hash_value FROM inv WHERE extension = 'csv'
  UNION ALL SELECT doc_id, replace(rel_path, '/', chr(92)), top_level_folder, extension, hash_value FROM inv WHERE extension = 'jpg'),
once AS (
  SELECT doc_id AS label_id, CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 7 = 0 THEN 'moved/' || rel_path WHEN doc_id % 2 = 1 THEN replace(rel_path, '/', chr(92)) ELSE rel_path END AS rel_path,
    CASE WHEN toxic = 1 THEN 'MIXED_PDF' WHEN quality = 1 THEN 'TEXT_PDF' ELSE 'image_pdf' END AS label_raw, '2024-01-01' AS labeled_at,
    CASE WHEN doc_id % 3 = 0 THEN doc_id::VARCHAR WHEN doc_id % 3 = 1 THEN '' ELSE '-5' END AS doc_id_at_label_time,
    CASE WHEN doc_id % 2 = 0 THEN sha256(text) ELSE '' END AS sha256_at_label_time
  FROM labels JOIN docs USING (doc_id)),
lab AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE label_raw = 'MIXED_PDF'),
keyed AS (SELECT *, replace(rel_path, chr(92), '/') AS norm_path FROM lab),
files AS (SELECT *, rel_path AS file_path, regexp_replace(replace(rel_path, chr(92), '/'), '^\\./', '') AS norm_path FROM inv2),
pick AS (
  SELECT *, count(*) OVER (PARTITION BY norm_path) AS n, count(*) FILTER (WHERE top_level_folder = split_part(norm_path, '/', 1)) OVER (PARTITION BY norm_path) AS n_own FROM files),
means AS (SELECT * FROM pick WHERE n = 1 OR (n_own = 1 AND top_level_folder = split_part(norm_path, '/', 1))),
matched AS (SELECT k.*, m.file_path, m.hash_value, m.doc_id FROM keyed k JOIN means m USING (norm_path)),
orphaned AS (
  SELECT rel_path, label_raw, CASE WHEN norm_path = '' THEN 'blank path' WHEN norm_path IN (SELECT norm_path FROM files) THEN 'several files' ELSE 'no file' END AS reason
  FROM keyed WHERE norm_path NOT IN (SELECT norm_path FROM means)),
unlabelled AS (SELECT rel_path, extension FROM files WHERE norm_path NOT IN (SELECT norm_path FROM matched))
"""
)
query("label_match", _LAB + "SELECT label_id, norm_path, file_path, label_raw FROM matched")(
    lambda s, d: labels.match(_labels(s, d), _inventory(s, d)).select("label_id", "norm_path", "file_path", "label_raw"),
)
query("label_orphans", _LAB + "SELECT * FROM orphaned")(lambda s, d: labels.orphaned(_labels(s, d), _inventory(s, d)))
query("label_unmatched", _LAB + "SELECT rel_path FROM unlabelled")(lambda s, d: labels.unmatched(_labels(s, d), _inventory(s, d)).select("rel_path"))
query(
    "label_recovery",
    _LAB
    + """, bysha AS (SELECT hash_value, min(rel_path) AS p FROM inv GROUP BY 1 HAVING min(rel_path) = max(rel_path))
SELECT label_id, CASE WHEN l.rel_path <> '' THEN l.rel_path ELSE coalesce(i.rel_path, b.p) END AS rel_path,
    CASE WHEN l.rel_path <> '' THEN 'kept' WHEN i.rel_path IS NOT NULL THEN 'doc_id' WHEN b.p IS NOT NULL THEN 'sha256' ELSE 'none' END AS recovered_by
  FROM lab l LEFT JOIN inv i ON l.doc_id_at_label_time = i.doc_id::VARCHAR LEFT JOIN bysha b ON l.sha256_at_label_time = b.hash_value""",
)(lambda s, d: labels.recover_paths(_labels(s, d), adapters.inventory(s, d)).select("label_id", "rel_path", "recovered_by"))
query(
    "label_reconcile",
    _LAB
    + """SELECT 'labels' AS what, count(*) AS n FROM lab UNION ALL SELECT 'matched', count(*) FROM matched
  UNION ALL SELECT 'orphaned', count(*) FROM orphaned UNION ALL SELECT 'unmatched', count(*) FROM unlabelled""",
)(lambda s, d: labels.reconcile_counts(_labels(s, d), _inventory(s, d)))
query(
    "label_migration",
    _LAB
    + """SELECT count(*) AS total_labels, count(*) FILTER (WHERE label_raw = 'TEXT_PDF') AS labels_to_change,
    count(*) FILTER (WHERE label_raw <> 'TEXT_PDF') AS labels_already_normalized, 0::BIGINT AS labels_unknown
  FROM lab""",
)(lambda s, d: labels.migration_report(_labels(s, d)))
query("label_migration_samples", _LAB + "SELECT norm_path AS rel_path FROM keyed WHERE label_raw = 'TEXT_PDF' ORDER BY 1 LIMIT 25")(lambda s, d: labels.migration_samples(_labels(s, d)))


def _upserted(spark: SparkSession, d: str) -> DataFrame:
    """Labels that have a path; mixed ones are labelled anew."""
    there = _labels(spark, d).filter("rel_path <> ''")
    mixed = there.filter("label_raw = 'MIXED_PDF'").distinct()
    return labels.upsert(there, mixed.withColumns({"label_raw": F.lit("TEXT_PDF"), "labeled_at": F.lit("2024-02-02")}))


query(
    "label_upsert",
    _LAB
    + """SELECT DISTINCT norm_path, CASE label_raw WHEN 'MIXED_PDF' THEN 'TEXT_PDF' ELSE label_raw END AS label_raw, CASE label_raw WHEN 'MIXED_PDF' THEN '2024-02-02' ELSE labeled_at END AS labeled_at,
    CASE label_raw WHEN 'image_pdf' THEN 'IMAGE_PDF' ELSE 'IMAGE_OF_TEXT_PDF' END AS label_norm
  FROM keyed WHERE rel_path <> ''""",
)(_upserted)
query(
    "label_drift",
    _LAB
    + """SELECT rel_path, doc_id_at_label_time <> '' AND doc_id_at_label_time <> doc_id::VARCHAR AS doc_id_mismatch,
    sha256_at_label_time <> '' AND sha256_at_label_time <> hash_value AS sha_mismatch
  FROM matched""",
)(lambda s, d: labels.drift(labels.match(_labels(s, d), _inventory(s, d))))
query("training_labels", _LAB + "SELECT label_id, CASE label_raw WHEN 'TEXT_PDF' THEN 'IMAGE_OF_TEXT_PDF' ELSE 'IMAGE_PDF' END AS label_norm FROM matched WHERE label_raw <> 'MIXED_PDF'")(
    lambda s, d: labels.training_rows(labels.match(_labels(s, d), _inventory(s, d)), exclude_mixed=True).select("label_id", "label_norm"),
)
query(
    "heuristic_predict",
    sql.READY.rstrip()
    + _LAB.replace("WITH ", ", ", 1)[_LAB.replace("WITH ", ", ", 1).index(",\ninv AS") :]
    + """, guess AS (SELECT rel_path, CASE classification WHEN 'Text-based' THEN 'TEXT_PDF' WHEN 'Scanned' THEN 'IMAGE_PDF' WHEN 'Mixed' THEN 'MIXED_PDF' END AS g FROM rdocs)
SELECT u.rel_path, coalesce(g, '') AS predicted_label, CASE WHEN g IS NULL THEN 'missing_probe_classification' ELSE 'probe_classification' END AS prediction_source
  FROM unlabelled u LEFT JOIN guess USING (rel_path) WHERE extension = 'pdf'""",
)(lambda s, d: labels.heuristic_predictions(labels.unmatched(_labels(s, d), _inventory(s, d)).filter("extension = 'pdf'"), ready_docs(s, d)))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    """Documents with truth, a prediction, its confidence and the heuristic type."""
    k = F.pmod(F.col("doc_id") * 37, F.lit(100))
    truth = table(spark, d, "labels").select("doc_id", labels.normalize_label(F.when(F.col("toxic") == 1, "MIXED_PDF").when(F.col("quality") == 1, "TEXT_PDF").otherwise("IMAGE_PDF")).alias("truth"))
    pred = F.when(k % 4 == 0, "IMAGE_PDF").when(k % 4 == 1, "MIXED_PDF").when(k % 4 == 2, "IMAGE_OF_TEXT_PDF").otherwise("")
    return ready_docs(spark, d).join(truth, "doc_id", "left").select("doc_id", "rel_path", "truth", pred.alias("pred"), (k / 100.0).alias("confidence"), readiness.heuristic(F.col("classification")).alias("heuristic"))


_PRED = sql.READY + """, preds AS (SELECT doc_id, rel_path, CASE WHEN toxic = 1 THEN 'MIXED_PDF' WHEN quality = 1 THEN 'IMAGE_OF_TEXT_PDF' WHEN quality = 0 THEN 'IMAGE_PDF' END AS truth,
  CASE doc_id * 37 % 100 % 4 WHEN 0 THEN 'IMAGE_PDF' WHEN 1 THEN 'MIXED_PDF' WHEN 2 THEN 'IMAGE_OF_TEXT_PDF' ELSE '' END AS pred, (doc_id * 37 % 100) / 100 AS confidence,
  CASE classification WHEN 'Text-based' THEN 'TEXT_PDF' WHEN 'Scanned' THEN 'IMAGE_PDF' ELSE 'MIXED_PDF' END AS heuristic
  FROM rdocs
  LEFT JOIN labels USING (doc_id)) """


def _decided(s: SparkSession, d: str) -> DataFrame:
    final, source = labels.decide(F.col("truth"), F.col("pred"), F.col("confidence"), F.col("heuristic"))
    return _predictions(s, d).select("doc_id", final.alias("doc_type_final"), source.alias("doc_type_source"))


query("doc_type_decision", _PRED + """SELECT doc_id, coalesce(truth, CASE WHEN confidence >= 0.7 AND pred <> '' THEN pred END, heuristic) AS doc_type_final, CASE WHEN truth IS NOT NULL THEN 'TRUTH' WHEN confidence >= 0.7 AND pred <> '' THEN 'MODEL' ELSE 'HEURISTIC' END AS doc_type_source
  FROM preds""")(_decided)
def _probed(s: SparkSession, d: str) -> DataFrame:
    """Probed documents as a probe run writes them: labels by path, some given twice, predictions and the decision."""
    rows = _predictions(s, d)
    given = rows.filter("truth is not null").select("rel_path", F.col("truth").alias("label_raw"), F.lit("2024-02").alias("labeled_at"))
    earlier = given.withColumns({"rel_path": F.concat(F.lit("./"), "rel_path"), "label_raw": F.lit("MIXED_PDF"), "labeled_at": F.lit("2024-01")})
    matched = labels.match(given.unionByName(earlier), adapters.inventory(s, d))
    predicted = rows.select("rel_path", F.col("pred").alias("predicted_label"), "confidence", F.lit("area").alias("reason_features"))
    decided = labels.with_decision(ready_docs(s, d), matched, predicted)
    return decided.select("doc_id", "rel_path", "doc_type_truth", "doc_type_heuristic", "doc_type_model_pred", F.round("model_confidence", 2).alias("model_confidence"), "reason_features", "doc_type_final", "doc_type_source")


query("probe_decisions", _PRED + """SELECT doc_id, rel_path, coalesce(truth, '') AS doc_type_truth, heuristic AS doc_type_heuristic, pred AS doc_type_model_pred, round(confidence, 2) AS model_confidence, 'area' AS reason_features,
  coalesce(truth, CASE WHEN confidence >= 0.7 AND pred <> '' THEN pred END, heuristic) AS doc_type_final, CASE WHEN truth IS NOT NULL THEN 'TRUTH' WHEN confidence >= 0.7 AND pred <> '' THEN 'MODEL' ELSE 'HEURISTIC' END AS doc_type_source
  FROM preds""")(_probed)
query("doc_type_confusion", _PRED + "SELECT truth, " + ", ".join(f"count(*) FILTER (WHERE pred = '{k}') AS {k}" for k in labels.LABELS) + " FROM preds WHERE truth IS NOT NULL AND pred <> '' GROUP BY 1")(
    lambda s, d: labels.confusion(_predictions(s, d)),
)
query("doc_type_evaluation", _PRED + """, k AS (SELECT truth, pred
  FROM preds
  WHERE truth IS NOT NULL AND pred <> ''), l AS (SELECT DISTINCT truth AS label
  FROM k UNION SELECT DISTINCT pred
  FROM k)
SELECT label, round(h / nullif(g, 0), 6) AS precision, round(h / nullif(s, 0), 6) AS recall, round(2 * h / (g + s), 6) AS f1, s AS support, round((SELECT count(*)
  FROM k
  WHERE truth = pred) / (SELECT count(*)
  FROM k), 6) AS accuracy
FROM (SELECT label, (SELECT count(*)
  FROM k
  WHERE truth = label AND pred = label) AS h, (SELECT count(*)
  FROM k
  WHERE pred = label) AS g, (SELECT count(*)
  FROM k
  WHERE truth = label) AS s
  FROM l)""")(
    lambda s, d: labels.evaluation(_predictions(s, d)),
)
query("doc_type_mismatches", _PRED + """SELECT doc_id, truth, pred, confidence
  FROM preds
  WHERE truth <> pred
  ORDER BY confidence DESC, doc_id LIMIT 50""")(
    lambda s, d: labels.mismatches(_predictions(s, d)),
)
query("label_queue", _PRED + """SELECT rel_path, suggested_label, confidence
  FROM (SELECT rel_path, pred AS suggested_label, confidence, split_part(rel_path, '/', 1) AS f, row_number() OVER (PARTITION BY split_part(rel_path, '/', 1)
  ORDER BY confidence, rel_path) AS turn
  FROM preds
  WHERE truth IS NULL)
  ORDER BY turn, f LIMIT 45""")(
    lambda s, d: labels.label_queue(_predictions(s, d).filter("truth is null").select("rel_path", F.col("pred").alias("suggested_label"), "confidence", paths.top_level_folder(F.col("rel_path")).alias("top_level_folder")), 45)
)


@query(
    "keyed_label_upsert",
    """SELECT doc_id, CASE WHEN doc_id % 100 = 7 THEN 1 - quality ELSE quality END AS quality, toxic FROM labels WHERE doc_id % 100 <> 9
UNION ALL SELECT doc_id + 100000000, quality, toxic FROM labels WHERE doc_id % 100 = 7""",
)
def _keyed_upsert(s: SparkSession, d: str) -> DataFrame:
    """The label table by document in buckets: one in a hundred labels changed, as many added, as many taken away."""
    rows = table(s, d, "labels")
    kept = KeyedTable.create(rows, f"{staging.working_folder(s)}/keyed/{uuid.uuid4().hex}", ["doc_id"], buckets=32)
    some = rows.filter("doc_id % 100 = 7")
    changed = some.withColumn("quality", (1 - F.col("quality")).cast(rows.schema["quality"].dataType))
    kept.upsert(changed.unionByName(some.withColumn("doc_id", F.col("doc_id") + 100_000_000)), delete=rows.filter("doc_id % 100 = 9"))
    return kept.read()
