"""Catalogs, run comparison, filters and searches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge import staging
from folioforge.functions import formats, paths
from folioforge.operators import catalogue_views as views
from folioforge.operators import doctype, probe, raster, readiness, textscan
from folioforge.plans import adapters
from folioforge.plans import reference_sql as sql
from folioforge.plans.adapters import page_text, table, with_tables
from folioforge.sources.text_index import TextIndex

from .inventory import INV as _INV
from .readiness import ready_docs
from .registry import query
from .textscan import quality


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    """The catalog of all files; only PDFs have been probed."""
    docs = textscan.document_signals(adapters.pdf_pages(spark, d))
    return views.public_index(adapters.inventory(spark, d), docs.withColumn("doc_type_final", readiness.heuristic(F.col("classification"))))


_PUBLIC = (
    sql.quality(4)
    + sql.READY[sql.READY.index(", rpages") :]
    + sql.NO_FIXTURE
    + sql.HITS
    + sql.TYPES
    + _INV.replace("WITH ", ", ", 1)[_INV.replace("WITH ", ", ", 1).index(",\ninv AS") :]
    + """, probed AS (
  SELECT * FROM rdocs LEFT JOIN quality USING (doc_id) LEFT JOIN types USING (doc_id) WHERE rel_path LIKE '%.pdf'),
cat AS (
  SELECT i.rel_path AS id, split_part(i.rel_path, '/', -1) AS title,
    CASE WHEN i.extension <> 'pdf' THEN 'NON_PDF (' || i.extension || ')' WHEN p.doc_id IS NULL THEN 'PDF (unprobed)' WHEN p.classification = 'Text-based' THEN 'TEXT_PDF'
      WHEN p.classification = 'Scanned' THEN 'IMAGE_PDF' ELSE 'MIXED_PDF' END AS doc_type_final,
    coalesce(p.content_type_pred, CASE WHEN i.extension <> 'pdf' THEN i.detected_mime END) AS content_type, p.classification, p.text_quality_label, coalesce(p.page_count, 0) AS page_count,
    i.top_level_folder AS dataset, i.rel_path, i.extension, i.detected_mime, i.size_bytes, i.modified_time
  FROM inv i LEFT JOIN probed p USING (rel_path))
"""
)
query("public_index", _PUBLIC + "SELECT * FROM cat")(lambda s, d: _catalog(s, d).drop("summary", "document_url", "created_time"))
query("catalog_order", _PUBLIC + "SELECT dataset, rel_path, id FROM cat ORDER BY dataset, rel_path")(lambda s, d: views.catalog_order(_catalog(s, d)).select("dataset", "rel_path", "id"))
query("catalog_breakdown", _PUBLIC + "SELECT dataset, extension AS ext, count(*) AS items, sum(size_bytes)::BIGINT AS bytes FROM cat GROUP BY ALL")(lambda s, d: views.breakdown(_catalog(s, d)))
query("catalog_datasets", _PUBLIC + "SELECT dataset, count(*) AS items, count(DISTINCT split_part(rel_path, '/', 1)) AS volumes FROM cat GROUP BY 1")(lambda s, d: views.dataset_summary(_catalog(s, d)))

# two probe runs: the first took PDFs, texts and unknown files, the second PDFs, tables and unknown files, and asks more of a page
_STRICT = readiness.Thresholds(page_chars=600)
_FIRST, _SECOND = ("pdf", "txt", "bin"), ("pdf", "csv", "bin")


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ext = paths.extension(F.col("rel_path"))
    return ready_docs(spark, d).filter(ext.isin(*_FIRST)), ready_docs(spark, d, _STRICT).filter(ext.isin(*_SECOND))


_CMP = (
    sql.READY
    + sql.READY[sql.READY.index(", rpages") :].replace("rpages", "spages").replace("rdocs", "sdocs").replace(">= 25", ">= 600")
    + f""", ra AS (SELECT * FROM rdocs WHERE split_part(rel_path, '.', 2) IN {_FIRST}), rb AS (SELECT * FROM sdocs WHERE split_part(rel_path, '.', 2) IN {_SECOND}),
cmp AS (
  SELECT coalesce(ra.doc_id, rb.doc_id) AS doc_id, CASE WHEN rb.doc_id IS NULL THEN 'only_a' WHEN ra.doc_id IS NULL THEN 'only_b' ELSE 'both' END AS status,
    coalesce(ra.classification, 'Unknown') AS class_a, coalesce(rb.classification, 'Unknown') AS class_b,
    coalesce(rb.page_count, 0) - coalesce(ra.page_count, 0) AS delta_page_count, coalesce(rb.pages_with_text, 0) - coalesce(ra.pages_with_text, 0) AS delta_pages_with_text,
    coalesce(rb.total_text_chars, 0) - coalesce(ra.total_text_chars, 0) AS delta_total_text_chars
  FROM ra FULL JOIN rb ON ra.doc_id = rb.doc_id)
"""
)


def _shift(key: str, where: str = "true") -> str:
    return f"""SELECT k AS value, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, coalesce(n_b, 0) - coalesce(n_a, 0) AS delta,
    CASE WHEN n_a IS NULL THEN 'Added' WHEN n_b IS NULL THEN 'Removed' ELSE 'In both' END AS status
  FROM (SELECT {key} AS k, count(*) AS n_a FROM ra GROUP BY 1) FULL JOIN (SELECT {key} AS k, count(*) AS n_b FROM rb GROUP BY 1) USING (k) WHERE {where}"""


def _with_ext(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ext", paths.extension(F.col("rel_path")))


query("run_class_shift", _CMP + _shift("classification"))(lambda s, d: views.count_shift(*_runs(s, d), "classification"))
query("run_ext_shift", _CMP + _shift("split_part(rel_path, '.', 2)", "k <> 'pdf'"))(lambda s, d: views.count_shift(*map(_with_ext, _runs(s, d)), "ext", without=("pdf",)))
_CUT = "2024-01-01T02:00:00+00:00"
query(
    "run_delta",
    _INV
    + f""", f AS (
  SELECT top_level_folder AS folder, count(*) AS c, sum(size_bytes) AS b FROM inv WHERE modified_time < '{_CUT}' GROUP BY 1
  UNION ALL SELECT '(total)', count(*), sum(size_bytes) FROM inv WHERE modified_time < '{_CUT}'),
l AS (
  SELECT top_level_folder AS folder, count(*) AS c, sum(size_bytes) AS b FROM inv GROUP BY 1
  UNION ALL SELECT '(total)', count(*), sum(size_bytes) FROM inv)
SELECT folder, coalesce(f.c, 0) AS files_first, coalesce(l.c, 0) AS files_last, coalesce(l.c, 0) - coalesce(f.c, 0) AS files_delta, (coalesce(l.b, 0) - coalesce(f.b, 0))::BIGINT AS bytes_delta
  FROM f FULL JOIN l USING (folder)""",
)(lambda s, d: views.run_delta(adapters.inventory(s, d).filter(F.col("modified_time") < _CUT), adapters.inventory(s, d)))


def _compared(s: SparkSession, d: str) -> DataFrame:
    return views.compare(*_runs(s, d))


query("run_compare", _CMP + "SELECT * FROM cmp")(_compared)
query("top_changes", _CMP + """SELECT doc_id, delta_page_count, delta_total_text_chars
  FROM cmp
  WHERE status = 'both'
  ORDER BY abs(delta_total_text_chars) DESC, doc_id LIMIT 50""")(
    lambda s, d: views.top_changes(_compared(s, d)),
)
query("only_once", _CMP + "SELECT doc_id, status FROM cmp WHERE status <> 'both'")(
    lambda s, d: views.only_once(_compared(s, d)),
)
_FILES = sql.READY + """, fdocs AS (SELECT r.*, split_part(rel_path, '.', 2) AS extension, round(strlen(text) / 1048576, 2) AS size_mb
  FROM rdocs r JOIN docs USING (doc_id, rel_path)) """


def _filtered(s: SparkSession, d: str) -> DataFrame:
    rows = views.with_files(ready_docs(s, d), adapters.inventory(s, d))
    return views.filter_documents(rows, pages=(2, 10), coverage=(0.5, 1.0), size_mb=(0.0, 0.02), extensions=("pdf", "txt"))


_FILTER = """FROM fdocs
  WHERE page_count BETWEEN 2 AND 10 AND text_coverage_pct BETWEEN 0.5 AND 1 AND size_mb BETWEEN 0 AND 0.02 AND extension IN ('pdf', 'txt')"""
query("doc_filter", _FILES + f"SELECT doc_id, extension, size_mb, page_count {_FILTER}")(
    lambda s, d: _filtered(s, d).select("doc_id", "extension", "size_mb", "page_count"),
)
query("doc_filter_by_type", _FILES + "SELECT doc_id, CASE extension WHEN 'txt' THEN 'text/plain' ELSE 'image/jpeg' END AS detected_mime, page_count FROM fdocs WHERE page_count >= 2 AND extension IN ('txt', 'jpg')")(
    lambda s, d: views.filter_documents(views.with_files(ready_docs(s, d), adapters.inventory(s, d)), pages=(2, 2**31 - 1), media_types=("text/plain", "image/jpeg")).select("doc_id", "detected_mime", "page_count"),
)
query("filter_kpis", _FILES + f"""SELECT count(*) AS docs, sum(page_count)::BIGINT AS pages, round(avg(text_coverage_pct), 6) AS avg_coverage, min(page_count) AS min_pages, max(page_count) AS max_pages {_FILTER}""")(
    lambda s, d: views.filter_kpis(_filtered(s, d)),
)
query("path_search", _INV + "SELECT rel_path FROM inv WHERE regexp_matches(rel_path, '(?i)vol0000[12]/(EN|de)/')")(
    lambda s, d: views.path_search(adapters.inventory(s, d), "vol0000[12]/(EN|de)/").select("rel_path"),
)
query("labeling_queue", sql.quality(4) + sql.READY[sql.READY.index(", rpages"):] + """SELECT r.doc_id, rel_path, page_count, text_quality_label
  FROM rdocs r
  LEFT JOIN quality USING (doc_id)
  WHERE r.doc_id NOT IN (SELECT doc_id
  FROM labels) AND page_count BETWEEN 1 AND 5 AND coalesce(text_quality_label, 'EMPTY') <> 'GOOD'""")(
    lambda s, d: views.labeling_queue(ready_docs(s, d), quality(s, d), table(s, d, "labels")),
)
query("verified_text", sql.quality(4) + "SELECT doc_id, text_quality_score FROM quality WHERE text_quality_label = 'GOOD'")(
    lambda s, d: quality(s, d).filter("text_quality_label = 'GOOD'").select("doc_id", "text_quality_score"),
)
for _best, _name, _way in ((True, "candidates_best", "DESC"), (False, "candidates_worst", "ASC")):
    query(_name, sql.READY + f"""SELECT doc_id, text_coverage_pct, page_count
  FROM rdocs
  ORDER BY text_coverage_pct {_way}, page_count {_way}, doc_id LIMIT 20""")(lambda s, d, best=_best: views.candidates(ready_docs(s, d), best))
query("keyword_search", with_tables("docs", "pages") + """, k AS (SELECT doc_id, page_num, len(regexp_extract_all(text, '(?i)the\\.')) AS n
  FROM pages) SELECT doc_id, sum(n)::BIGINT AS matches, count(*) AS pages, string_agg(page_num || ':' || n, ','
  ORDER BY page_num) AS page_hits
  FROM k
  WHERE n > 0
  GROUP BY 1""")(
    lambda s, d: views.keyword_search(page_text(s, d), "the."),
)


def _indexed(s: SparkSession, d: str, words: str) -> DataFrame:
    index = TextIndex.build(page_text(s, d), f"{staging.working_folder(s)}/index/{uuid.uuid4().hex}", pages_per_block=200)
    return index.search(words)


_SEARCHED = with_tables("docs", "pages") + """, k AS (SELECT doc_id, page_num, len(regexp_extract_all(text, '(?i){}')) AS n FROM pages)
SELECT doc_id, sum(n)::BIGINT AS matches, count(*) AS pages, string_agg(page_num || ':' || n, ',' ORDER BY page_num) AS page_hits FROM k WHERE n > 0 GROUP BY 1"""
query("indexed_search", _SEARCHED.format("example[.]com"))(lambda s, d: _indexed(s, d, "Example.com"))
query("indexed_search_of_two_letters", _SEARCHED.format("qu"))(lambda s, d: _indexed(s, d, "QU"))
query("indexed_search_without_hits", _SEARCHED.format("qqqjjjxxx"))(lambda s, d: _indexed(s, d, "qqqjjjxxx"))
_HASHED = "sha256(doc_id || '|42')"
query("sample_docs", with_tables("docs") + f"SELECT doc_id FROM docs ORDER BY {_HASHED}, doc_id LIMIT 50")(
    lambda s, d: views.sample(adapters.documents(s, d).select("doc_id"), "doc_id", 50, 42),
)
query("train_eval_split", """SELECT doc_id, quality, row_number() OVER (PARTITION BY quality
  ORDER BY sha256(doc_id || '|7'), doc_id) <= ceil(count(*) OVER (PARTITION BY quality) * 0.25) AS held_out
  FROM labels""")(
    lambda s, d: doctype.split(table(s, d, "labels").select("doc_id", "quality"), "quality", "doc_id", 0.25, 7),
)
def _written(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", formats.percent(F.col("text_coverage_pct")).alias("coverage"), formats.percent(formats.share(F.col("pages_with_text"), F.col("page_count") - 1), 2).alias("share"),
        formats.signed((F.col("total_text_chars") - 1000).cast("long")).alias("delta"), formats.signed_percent(F.col("text_coverage_pct") - 0.5).alias("delta_pct"),
    )


query(
    "written_numbers",
    sql.READY
    + """SELECT doc_id, printf('%.1f%%', text_coverage_pct * 100) AS coverage, printf('%.2f%%', coalesce(pages_with_text / nullif(page_count - 1, 0), 0) * 100) AS share,
    CASE WHEN total_text_chars > 1000 THEN '+' ELSE '' END || format('{:,}', total_text_chars - 1000) AS delta,
    CASE WHEN text_coverage_pct > 0.5 THEN '+' ELSE '' END || printf('%.1f%%', (text_coverage_pct - 0.5) * 100) AS delta_pct
  FROM rdocs""",
)(lambda s, d: _written(ready_docs(s, d)))
query(
    "prepared_runs",
    sql.READY + "SELECT doc_id::VARCHAR AS doc_id, rel_path, '' AS top_level_folder, page_count, pages_with_text, 0::BIGINT AS total_text_chars, text_coverage_pct, 'Unknown' AS classification FROM rdocs",
)(lambda s, d: views.prepared(ready_docs(s, d).drop("classification").withColumns({"page_count": F.col("page_count").cast("string"), "total_text_chars": F.lit("many")})))
query("sorted_by_size", _FILES + "SELECT rel_path, page_count, size_mb FROM fdocs ORDER BY size_mb DESC, rel_path")(
    lambda s, d: views.sort_documents(views.with_files(ready_docs(s, d), adapters.inventory(s, d)), "size", ascending=False).select("rel_path", "page_count", "size_mb"),
)
query(
    "facets",
    _FILES
    + """SELECT 'classification' AS facet, classification AS value, count(*) AS n FROM fdocs GROUP BY 2
  UNION ALL SELECT 'extension', extension, count(*) FROM fdocs GROUP BY 2""",
)(lambda s, d: views.facets(views.with_files(ready_docs(s, d), adapters.inventory(s, d)), ("classification", "extension")))
query("needing_attention", sql.READY + "SELECT doc_id, classification FROM rdocs WHERE classification <> 'Text-based'")(
    lambda s, d: views.needing_attention(ready_docs(s, d)).select("doc_id", "classification"),
)
query("pages_lacking_text", sql.READY + "SELECT doc_id, rel_path, page_num, text_char_count FROM rpages WHERE text_char_count < 120")(
    lambda s, d: views.pages_lacking_text(readiness.pages(page_text(s, d)), 120),
)
_SAFE = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
query("highlights", with_tables("docs", "pages") + f"SELECT doc_id, page_num, regexp_replace({_SAFE}, '(?i)(the\\.)', '<mark>\\1</mark>', 'g') AS marked FROM pages WHERE regexp_matches(text, '(?i)the\\.')")(
    lambda s, d: views.highlight(page_text(s, d), "the."),
)
query(
    "sample_pages",
    with_tables("docs", "pages")
    + """SELECT doc_id, page_num
  FROM pages QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sha256(doc_id || '|' || page_num || '|42'), page_num) <= 3""",
)(lambda s, d: views.sample(page_text(s, d).select("doc_id", "page_num"), "page_num", 3, 42, within="doc_id"))
query(
    "page_sample_by_path",
    with_tables("docs", "pages")
    + """SELECT rel_path, page_num
  FROM pages QUALIFY row_number() OVER (PARTITION BY rel_path ORDER BY sha256(rel_path || '|' || page_num || '|7'), page_num) <= 2""",
)(lambda s, d: raster.page_sample(page_text(s, d).select("rel_path", "page_num"), 2, 7))


def _pdfs(spark: SparkSession, d: str) -> DataFrame:
    """PDFs of the inventory; those in English lie in the archive that they came in, and have been extracted."""
    rows = adapters.inventory(spark, d).filter("extension = 'pdf'")
    taken = F.when(F.col("rel_path").contains("/en/"), F.concat(F.lit("/extracted/"), "rel_path"))
    return rows.select("doc_id", "rel_path", "top_level_folder", taken.alias("probe_path"), F.concat(F.lit("/data/"), "rel_path").alias("abs_path"))


query(
    "pdfs_with_probe",
    sql.READY
    + """SELECT d.doc_id, d.rel_path, r.page_count, r.text_coverage_pct, coalesce(r.classification, 'Unknown') AS classification
  FROM docs d LEFT JOIN rdocs r USING (rel_path) WHERE d.rel_path LIKE '%.pdf'""",
)(lambda s, d: probe.with_probe(_pdfs(s, d), ready_docs(s, d)).select("doc_id", "rel_path", "page_count", "text_coverage_pct", "classification"))


def _to_scan(spark: SparkSession, d: str) -> DataFrame:
    docs = ready_docs(spark, d)
    return probe.for_scan(docs.withColumn("doc_id", F.when(F.col("classification") == "Text-based", F.col("doc_id"))), _pdfs(spark, d))


_SCAN = (
    sql.READY
    + """, scan AS (
  SELECT rel_path, CASE WHEN rel_path LIKE '%.pdf' OR classification = 'Text-based' THEN doc_id::VARCHAR END AS doc_id, CASE WHEN rel_path LIKE '%.pdf' THEN split_part(rel_path, '/', 1) END AS top_level_folder,
    CASE WHEN rel_path LIKE '%/en/%.pdf' THEN '/extracted/' || rel_path WHEN rel_path LIKE '%.pdf' THEN '/data/' || rel_path END AS scan_path
  FROM rdocs)
"""
)
query("scan_paths", _SCAN + "SELECT rel_path, doc_id, top_level_folder, scan_path FROM scan")(lambda s, d: _to_scan(s, d).select("rel_path", "doc_id", "top_level_folder", "scan_path"))
query("scan_errors", _SCAN + "SELECT rel_path, 'missing scan path' AS error FROM scan WHERE scan_path IS NULL")(lambda s, d: probe.scan_errors(_to_scan(s, d)))
