"""Text readiness: pages, documents, and views of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioforge.operators import catalogue_views as views
from folioforge.operators import readiness
from folioforge.plans import reference_sql as sql
from folioforge.plans.adapters import page_text, with_tables

from .registry import query


def ready_docs(spark: SparkSession, d: str, at: readiness.Thresholds = readiness.Thresholds()) -> DataFrame:
    return readiness.docs(readiness.pages(page_text(spark, d), at), at)


query("readiness_pages", sql.READY + "SELECT * FROM rpages")(
    lambda s, d: readiness.pages(page_text(s, d)),
)
query("readiness_docs", sql.READY + "SELECT * FROM rdocs")(ready_docs)
query("probe_summary", sql.READY + """SELECT classification, count(*) AS docs, sum(page_count)::BIGINT AS pages, sum(pages_with_text)::BIGINT AS with_text, greatest(sum(page_count) - sum(pages_with_text), 0)::BIGINT AS without_text, round(count(*) / sum(count(*)) OVER () * 100, 6) AS pct_docs
  FROM rdocs
  GROUP BY 1""")(
    lambda s, d: readiness.summary(ready_docs(s, d)),
)
query("least_text_docs", sql.READY + """SELECT doc_id, text_coverage_pct, total_text_chars
  FROM rdocs
  ORDER BY text_coverage_pct, total_text_chars, doc_id LIMIT 20""")(
    lambda s, d: readiness.least_text(ready_docs(s, d)),
)
query("text_page_index", sql.READY + """SELECT rel_path, string_agg(page_num::VARCHAR, ','
  ORDER BY page_num) AS pages
  FROM rpages
  WHERE has_text
  GROUP BY 1""")(
    lambda s, d: views.text_page_index(readiness.pages(page_text(s, d))),
)
query("document_text", with_tables("docs", "pages") + """SELECT doc_id, string_agg('--- Page ' || page_num || ' ---' || chr(10) || text, chr(10) || chr(10)
  ORDER BY page_num) AS document_text
  FROM pages
  GROUP BY 1""")(
    lambda s, d: views.document_text(page_text(s, d)),
)
query("page_histogram", sql.READY + """SELECT least(floor((page_count - 1) / 40.0 * 20), 19)::INT AS bin, count(*) AS docs
  FROM rdocs
  WHERE page_count BETWEEN 1 AND 41
  GROUP BY 1""")(
    lambda s, d: views.numeric_histogram(ready_docs(s, d), "page_count", 1.0, 41.0),
)
query("display_labels", sql.READY + """SELECT doc_id, rel_path || ' · ' || classification || ' · ' || page_count || ' pages' AS display_label
  FROM rdocs""")(
    lambda s, d: views.display_label(ready_docs(s, d)),
)
