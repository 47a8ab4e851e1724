"""Inventories: rollups, duplicates, issues, what is probed and what left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import formats, paths
from folioforge.operators import inventory, probe
from folioforge.plans import adapters
from folioforge.plans.adapters import table, with_tables

from .registry import query

NOW = "2024-01-05 00:00:00"
INV = with_tables("docs", "inv")


def on_inventory(name: str, operator: Callable[[DataFrame], DataFrame], oracle: str) -> None:
    query(name, f"{INV} {oracle}")(lambda spark, d: operator(adapters.inventory(spark, d)))


on_inventory(
    "inventory_scan",
    lambda inv: inv.select("rel_path", "top_level_folder", "extension", "detected_mime", "size_bytes", "modified_time", paths.file_name(F.col("rel_path")).alias("name"), paths.parent(F.col("rel_path")).alias("folder"), paths.file_category(F.col("extension"), F.col("detected_mime")).alias("category"), formats.human_bytes(F.col("size_bytes")).alias("size_text")),
    """SELECT rel_path, top_level_folder, extension, detected_mime, size_bytes, modified_time, split_part(rel_path, '/', 3) AS name, regexp_replace(rel_path, '/[^/]*$', '') AS folder,
  CASE extension WHEN 'pdf' THEN 'pdf' WHEN 'txt' THEN 'text' WHEN 'csv' THEN 'csv' WHEN 'jpg' THEN 'image' ELSE 'other' END AS category,
  CASE WHEN size_bytes < 1024 THEN printf('%.1f B', size_bytes::DOUBLE) ELSE printf('%.1f KB', size_bytes / 1024) END AS size_text
  FROM inv""",
)
on_inventory(
    "inventory_file_id",
    lambda inv: inv.select("rel_path", paths.file_id(F.col("rel_path"), F.col("size_bytes"), F.lit(0.0), F.col("hash_value")).alias("file_id"), paths.file_id(F.col("rel_path"), F.col("size_bytes"), F.lit(1.5), F.lit(None)).alias("file_id_without_hash"), paths.stable_doc_id(F.lit(""), F.col("rel_path"), F.col("size_bytes"), F.col("modified_time")).alias("stable_doc_id")),
    """SELECT rel_path, sha256(hash_value) AS file_id, sha256(rel_path || '|' || size_bytes || '|1.500000') AS file_id_without_hash, rel_path || '|' || size_bytes || '|' || modified_time AS stable_doc_id
  FROM inv""",
)
on_inventory(
    "inventory_summary", inventory.summary,
    """SELECT 'total' AS level, '' AS value, count(*) AS files, sum(size_bytes)::BIGINT AS bytes
  FROM inv
  UNION ALL SELECT 'extension', extension, count(*), sum(size_bytes)::BIGINT
  FROM inv
  GROUP BY 2
  UNION ALL SELECT 'mime', detected_mime, count(*), sum(size_bytes)::BIGINT
  FROM inv
  GROUP BY 2
  UNION ALL SELECT 'folder', top_level_folder, count(*), sum(size_bytes)::BIGINT
  FROM inv
  GROUP BY 2""",
)
on_inventory("folder_rollup", inventory.folder_rollup, """SELECT top_level_folder, count(*) AS files, sum(size_bytes)::BIGINT AS bytes, round(sum(size_bytes) / greatest(sum(sum(size_bytes)) OVER (), 1) * 100, 6) AS pct_bytes
  FROM inv
  GROUP BY 1""")
on_inventory("ext_mime_counts", inventory.ext_mime_counts, "SELECT extension, detected_mime, count(*) AS files FROM inv GROUP BY ALL")
on_inventory(
    "size_histogram", inventory.size_histogram,
    """SELECT b.bin::INT AS bin, b.lo::BIGINT AS from_bytes, count(size_bytes) AS files
  FROM (VALUES (1,0,1024),(2,1024,10000),(3,10000,100000),(4,100000,1000000),(5,1000000,10000000),(6,10000000,100000000),(7,100000000,1000000000),(8,1000000000,9e18)) b(bin, lo, hi)
  LEFT JOIN inv ON size_bytes >= lo AND size_bytes < hi
  GROUP BY ALL""",
)
on_inventory("largest_files", inventory.largest_files, "SELECT rel_path, size_bytes FROM inv ORDER BY size_bytes DESC, rel_path LIMIT 20")
on_inventory("deepest_paths", inventory.deepest_paths, """SELECT regexp_replace(rel_path, '/[^/]*$', '') AS folder, count(*) AS files, 2 AS depth
  FROM inv
  GROUP BY 1
  ORDER BY depth DESC, files DESC, folder LIMIT 20""")
on_inventory(
    "exec_summary", inventory.executive_summary,
    """SELECT count(*) AS files, round(sum(size_bytes) / 1024.0**3, 9) AS gib, count(DISTINCT top_level_folder) AS folders, count(*) FILTER (WHERE extension = 'pdf') AS n_pdf, count(*) FILTER (WHERE extension = 'txt') AS n_text, count(*) FILTER (WHERE extension = 'csv') AS n_csv, count(*) FILTER (WHERE extension = 'jpg') AS n_image, count(*) FILTER (WHERE extension = 'bin') AS n_other
  FROM inv""",
)
on_inventory("file_categories", inventory.file_categories, """SELECT CASE extension WHEN 'pdf' THEN 'pdf' WHEN 'txt' THEN 'text' WHEN 'csv' THEN 'csv' WHEN 'jpg' THEN 'image' ELSE 'other' END AS category, count(*) AS files
  FROM inv
  GROUP BY 1""")
on_inventory("ext_by_folder_top12", inventory.ext_by_folder, """SELECT extension, top_level_folder, count(*) AS files
  FROM inv
  WHERE extension IN (SELECT extension
  FROM inv
  GROUP BY 1
  ORDER BY count(*) DESC, 1 LIMIT 12)
  GROUP BY ALL""")
on_inventory("duplicate_groups", inventory.duplicate_groups, """SELECT hash_value AS dup_key, count(*) AS n, sum(size_bytes)::BIGINT AS bytes, array_to_string(list_sort(list(rel_path))[:3], '|') AS example_paths
  FROM inv
  GROUP BY 1
  HAVING count(*) >= 2""")
on_inventory(
    "potential_issues", lambda inv: inventory.potential_issues(inv, F.lit(NOW).cast("timestamp"), large=20_000),
    f"""SELECT *
  FROM (SELECT rel_path, size_bytes, array_to_string(list_filter([CASE WHEN size_bytes = 0 THEN 'zero_size' END, CASE WHEN detected_mime = 'application/octet-stream' THEN 'missing_mime' END, CASE WHEN size_bytes >= 20000 THEN 'very_large' END,
  CASE WHEN extension = 'bin' THEN 'uncommon_extension' END, CASE WHEN modified_time::TIMESTAMP > TIMESTAMP '{NOW}' THEN 'future_modified_time' END], lambda x: x IS NOT NULL), ', ') AS issues
  FROM inv)
  WHERE issues <> ''""",
)
query("pdf_candidates", INV + "SELECT hash_value AS doc_key, rel_path FROM inv WHERE extension = 'pdf' AND top_level_folder = 'VOL00003'")(
    lambda s, d: probe.candidates(adapters.inventory(s, d), "VOL00003").select("doc_key", "rel_path"),
)
query("ignored_counts", INV + """SELECT 'extension' AS level, extension AS value, count(*) AS files
  FROM inv
  WHERE extension <> 'pdf'
  GROUP BY 2
  UNION ALL SELECT 'mime', detected_mime, count(*)
  FROM inv
  WHERE extension <> 'pdf'
  GROUP BY 2""")(
    lambda s, d: probe.ignored_counts(adapters.inventory(s, d)),
)
query("selected_rows", INV + "SELECT doc_id FROM inv WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")(
    lambda s, d: probe.select_listed(adapters.inventory(s, d), table(s, d, "labels").filter("toxic = 1").select("doc_id")).select("doc_id"),
)
query("sanitized_labels", "SELECT url, trim(regexp_replace(url, '[^A-Za-z0-9.-]+', '_', 'g'), '_') AS label FROM pages")(
    lambda s, d: table(s, d, "pages").select("url", probe.sanitized_label(F.col("url")).alias("label")),
)
