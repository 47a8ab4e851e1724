"""Text scan: quality, content type, and their merge with the probe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import catalogue_views as views
from folioforge.operators import readiness, textscan
from folioforge.plans import adapters, fixtures
from folioforge.plans import reference_sql as sql
from folioforge.plans.adapters import page_text, with_tables

from .registry import query


def quality(spark: SparkSession, d: str) -> DataFrame:
    return textscan.text_quality(page_text(spark, d))


query("text_quality", sql.quality(4) + "SELECT * FROM quality")(quality)
query("text_quality_variant_runs3", sql.quality(3) + "SELECT * FROM quality")(
    lambda s, d: textscan.text_quality(page_text(s, d), textscan.Quality(run=3)),
)
_SAMPLE = sql.SCAN.replace("scan AS", "whole AS", 1) + """, scan AS (SELECT doc_id, rel_path, page_num, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5('7|' || doc_id || '|' || page_num)) AS place FROM whole) WHERE place <= 3)"""
query("text_quality_sampled_pages", sql.quality(4, _SAMPLE) + "SELECT * FROM quality")(
    lambda s, d: textscan.text_quality(textscan.scanned_pages(page_text(s, d), max_pages=3, seed=7)),
)
query("text_scan_summary", sql.quality(4) + """SELECT text_quality_label, count(*) AS docs, round(avg(text_quality_score), 6) AS mean_score
  FROM quality
  GROUP BY 1""")(
    lambda s, d: textscan.quality_summary(quality(s, d)),
)
query("text_ready_kpis", sql.quality(4) + """SELECT count(*) AS docs, round(count(*) FILTER (WHERE text_quality_label = 'GOOD') / count(*), 6) AS good_share, round(count(*) FILTER (WHERE text_quality_label <> 'GOOD') / count(*), 6) AS poor_share
  FROM quality""")(
    lambda s, d: views.text_ready(quality(s, d)),
)
query(
    "snippets",
    with_tables("docs", "pages")
    + sql.SCAN
    + f""", f AS (SELECT doc_id, arg_min(text, page_num) AS text
  FROM scan
  WHERE {sql._strip("text")} <> ''
  GROUP BY 1), m AS (SELECT doc_id,
  regexp_replace(regexp_replace({sql._strip(f"regexp_replace(text, '[{sql.W}]+', ' ', 'g')")}, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{{2,}}', '[email]', 'g'), '\\b\\d{{5,}}\\b', '[number]', 'g') AS t
  FROM f)
  SELECT doc_id, CASE WHEN length(t) <= 200 THEN t ELSE rtrim(substr(t, 1, 200)) || '…' END AS text_snippet
  FROM m""",
)(lambda s, d: textscan.snippets(page_text(s, d)))
_RULE_PAGES = with_tables("docs", "pages") + f", fixture(doc_id, text) AS (VALUES {fixtures.values(fixtures.RULE_PAGES)})"
_FIXTURE = _RULE_PAGES + sql.HITS


def _hits(spark: SparkSession, d: str, every_page: bool = False) -> DataFrame:
    return textscan.rule_hits(page_text(spark, d).unionByName(fixtures.rule_pages(spark)), every_page)


query("content_rule_hits", _FIXTURE + " SELECT * FROM hits")(_hits)
query("content_type", _FIXTURE + sql.TYPES + " SELECT * FROM types")(
    lambda s, d: textscan.content_type(_hits(s, d)),
)


def text_scan(spark: SparkSession, d: str, every_page: bool = False) -> DataFrame:
    """What a text scan finds: signals of PDFs with at least one page of text.

    Quality and type are those of an id, over all rows that bear it; readiness is that of each of its paths.
    """
    pages = adapters.pdf_pages(spark, d)
    of_id = textscan.document_signals(pages.withColumn("rel_path", F.lit(None).cast("string")), every_page=every_page)
    ready = readiness.docs(readiness.pages(pages))
    return ready.filter("pages_with_text >= 1").join(of_id.drop(*ready.columns[1:]), "doc_id")


def _signals(scan: str) -> str:
    return (
        sql.quality(4, scan)
        + sql.READY[sql.READY.index(", rpages") :]
        + sql.NO_FIXTURE
        + sql.hits(scan)
        + sql.TYPES
        + """, signals AS (
  SELECT doc_id, rel_path, text_quality_label, text_quality_score, content_type_pred, content_type_confidence
  FROM rdocs JOIN quality USING (doc_id) JOIN types USING (doc_id)
  WHERE rel_path LIKE '%.pdf' AND pages_with_text >= 1)
"""
    )


SIGNALS = _signals(sql.SCAN)


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return adapters.documents(spark, d).select("doc_id", "rel_path")


_MERGED = "SELECT docs.doc_id, docs.rel_path, text_quality_label, text_quality_score, content_type_pred, content_type_confidence FROM docs LEFT JOIN signals USING (rel_path)"
query("merge_text_signals", SIGNALS + _MERGED)(lambda s, d: textscan.merge_signals(_documents(s, d), text_scan(s, d)))
query("merge_of_same_run", _signals(sql.EVERY_PAGE) + _MERGED)(lambda s, d: textscan.merge_if_same_run(_documents(s, d), text_scan(s, d, every_page=True), "run_a", "run_a"))
query("merge_of_other_run", with_tables("docs") + "SELECT doc_id, rel_path, NULL::VARCHAR AS text_quality_label, NULL::DOUBLE AS text_quality_score, NULL::VARCHAR AS content_type_pred, NULL::DOUBLE AS content_type_confidence FROM docs")(
    lambda s, d: textscan.merge_if_same_run(_documents(s, d), text_scan(s, d), "run_a", "run_b"),
)
query(
    "merge_coverage",
    SIGNALS
    + """SELECT count(*) AS paths, count(s.rel_path) AS merged, round(count(s.rel_path) / count(*), 6) AS coverage, NULL::VARCHAR AS unmerged_reason
  FROM (SELECT DISTINCT rel_path FROM docs) d LEFT JOIN (SELECT DISTINCT rel_path FROM signals) s USING (rel_path)""",
)(lambda s, d: textscan.merge_coverage(_documents(s, d), text_scan(s, d)))
query(
    "merge_without_common_paths",
    with_tables("docs") + "SELECT count(DISTINCT rel_path) AS paths, 0::BIGINT AS merged, 0.0::DOUBLE AS coverage, 'no path in common' AS unmerged_reason FROM docs",
)(lambda s, d: textscan.merge_coverage(_documents(s, d), _documents(s, d).selectExpr("concat('other/', rel_path) as rel_path")))
query(
    "document_signals",
    sql.quality(4)
    + sql.READY[sql.READY.index(", rpages") :]
    + sql.NO_FIXTURE
    + sql.HITS
    + sql.TYPES
    + """SELECT doc_id, classification, text_coverage_pct, text_quality_label, text_quality_score, content_type_pred, content_type_confidence
  FROM rdocs LEFT JOIN quality USING (doc_id) LEFT JOIN types USING (doc_id)""",
)(
    lambda s, d: textscan.document_signals(page_text(s, d)).select(
        "doc_id", "classification", "text_coverage_pct", "text_quality_label", "text_quality_score", "content_type_pred", "content_type_confidence"
    ),
)
query("text_scan_candidates", sql.READY + "SELECT doc_id, pages_with_text FROM rdocs WHERE pages_with_text >= 2")(
    lambda s, d: textscan.scanned(textscan.document_signals(page_text(s, d)), 2).select("doc_id", "pages_with_text"),
)
query("content_type_signals", _RULE_PAGES + sql.hits(sql.EVERY_PAGE) + sql.SIGNALS_JSON)(lambda s, d: textscan.signals_json(_hits(s, d, every_page=True)))
