"""Person names: mentions, the index, its views and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import names
from folioforge.plans import adapters, fixtures
from folioforge.plans import reference_sql as sql
from folioforge.plans.adapters import page_text

from .readiness import ready_docs
from .registry import query
from .textscan import SIGNALS, text_scan

_NAMES = sql.NAMES


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    return names.mentions_of(page_text(spark, d), plain_headings=True)  # as in their SQL, which knows the case of ASCII letters only


def name_documents(spark: SparkSession, d: str) -> DataFrame:
    return names.name_documents(_mentions(spark, d))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return names.name_records(name_documents(spark, d))


query("name_mentions", _NAMES + "SELECT canonical_key, doc_id, page_num, count(*) AS n FROM mentions GROUP BY ALL")(
    lambda s, d: _mentions(s, d).groupBy("canonical_key", "doc_id", "page_num").agg(F.count("*").alias("n")),  # pages of one id are one, whatever their path
)
query("name_index", _NAMES + "SELECT canonical_key, display_name, array_to_string(variants, '; ') AS variants, total_count, docs FROM idx")(
    lambda s, d: _records(s, d).select("canonical_key", "display_name", F.array_join("variants", "; ").alias("variants"), "total_count", "docs"),
)
query("public_name_index", _NAMES + "SELECT canonical_key, display_name, docs AS n_docs FROM idx")(
    lambda s, d: published(s, d).select("canonical_key", "display_name", F.json_array_length("docs_json").cast("long").alias("n_docs")),
)
query("name_summary", _NAMES + """SELECT count(*) AS total_names, sum(total_count)::BIGINT AS total_mentions, (SELECT count(DISTINCT doc_id)
  FROM mentions) AS total_docs_with_mentions
  FROM idx""")(lambda s, d: names.summary(name_documents(s, d)))
query(
    "name_flatten",
    _NAMES + """, pg AS (SELECT canonical_key, doc_id, rel_path, page_num, count(*) AS n FROM mentions GROUP BY ALL)
SELECT canonical_key, display_name, array_to_string(variants, ', ') AS variants, doc_id, rel_path, string_agg('p.' || page_num || ' (' || n || '×)', ', '
  ORDER BY page_num) AS page_list, sum(n)::BIGINT AS total_count
  FROM pg JOIN idx USING (canonical_key)
  GROUP BY ALL""",
)(lambda s, d: names.flatten(name_documents(s, d)))
query(
    "name_lookup",
    _NAMES + f""", q0(query) AS (VALUES {fixtures.values(fixtures.NAME_QUERIES)}), q AS (SELECT query, lower(trim(query)) AS q, CASE WHEN contains(query, ',') THEN trim(split_part(lower(query), ',', 1)) || '|' || trim(split_part(lower(query), ',', 2)) WHEN contains(trim(query), ' ') THEN split_part(lower(trim(query)), ' ', -1) || '|' || split_part(lower(trim(query)), ' ', 1) END AS k
  FROM q0
  WHERE trim(query) <> ''),
h AS (SELECT query, CASE WHEN canonical_key = k THEN 1 WHEN list_contains(variants, q) THEN 2 WHEN contains(lower(display_name), q) THEN 3 END AS stage, canonical_key, display_name, total_count
  FROM idx, q)
SELECT query, stage, canonical_key, display_name, total_count
  FROM h
  WHERE stage IS NOT NULL
  QUALIFY stage = min(stage) OVER (PARTITION BY query)""",
)(lambda s, d: names.lookup(_records(s, d), s.createDataFrame([(q,) for q in fixtures.NAME_QUERIES], "query string")))
query(
    "name_search",
    _NAMES
    + """SELECT canonical_key, display_name, total_count FROM idx
  WHERE total_count >= 2 AND (contains(lower(display_name), 'an') OR contains(canonical_key, 'an') OR contains(array_to_string(variants, '; '), 'an'))""",
)(lambda s, d: names.search(_records(s, d), " AN ", least=2).select("canonical_key", "display_name", "total_count"))
query("crowded_documents", _NAMES + "SELECT rel_path, doc_id, 'exceeded max_names_per_doc=5' AS error FROM mentions GROUP BY ALL HAVING count(DISTINCT canonical_key) > 5")(
    lambda s, d: names.crowded_documents(_mentions(s, d), 5, each_path=True),  # as in its SQL
)
query(
    "name_index_capped",
    _NAMES
    + """SELECT canonical_key, count(*) AS docs, sum(n)::BIGINT AS total_count FROM dd
  WHERE doc_id NOT IN (SELECT doc_id FROM mentions GROUP BY 1 HAVING count(DISTINCT canonical_key) > 5) GROUP BY 1""",
)(lambda s, d: names.name_records(names.name_documents(_mentions(s, d), 5)).select("canonical_key", "docs", "total_count"))


def _metadata(spark: SparkSession, d: str, only_good: bool = True) -> DataFrame:
    """Documents (of good text), as a name index is made of them: probed PDFs, the text scan, the inventory."""
    pdfs = adapters.inventory(spark, d).filter("extension = 'pdf'")
    return names.document_metadata(ready_docs(spark, d), text_scan(spark, d), pdfs, only_good)


def published(spark: SparkSession, d: str) -> DataFrame:
    """The public records of all documents, with what is known of each."""
    return names.public_records(names.name_index(name_documents(spark, d), _metadata(spark, d, only_good=False), each_path=True))


_METADATA = SIGNALS + """, meta AS (
  SELECT r.doc_id::VARCHAR AS doc_id, r.rel_path, r.page_count::INT AS page_count, split_part(r.rel_path, '/', 1) AS top_level_folder, content_type_pred AS content_type,
    split_part(r.rel_path, '/', -1) AS title
  FROM rdocs r JOIN signals s ON r.rel_path = s.rel_path WHERE text_quality_label = 'GOOD')
"""
query("document_metadata", _METADATA + "SELECT doc_id, rel_path, page_count, top_level_folder, NULL::VARCHAR AS document_url, NULL::VARCHAR AS doc_type_final, content_type, title, 'GOOD' AS text_quality_label FROM meta")(
    _metadata,
)
query(
    "name_index_of_good_documents",
    _NAMES + _METADATA[_METADATA.index(", scan AS") :] + "SELECT canonical_key, doc_id, page_count, title, n AS total_count FROM (SELECT canonical_key, doc_id::VARCHAR AS doc_id, n FROM dd) JOIN meta USING (doc_id)",
)(lambda s, d: _nested(s, d))


def _nested(spark: SparkSession, d: str) -> DataFrame:
    """The export form, opened again: every nested document with its metadata."""
    meta = _metadata(spark, d)
    docs = name_documents(spark, d).withColumn("doc_id", F.col("doc_id").cast("string"))
    index = names.name_index(docs.join(meta.select("doc_id"), "doc_id", "left_semi"), meta)
    return index.select("canonical_key", F.explode("internal_docs").alias("d")).select("canonical_key", "d.doc_id", "d.page_count", "d.title", "d.total_count")
