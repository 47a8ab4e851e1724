"""File trees: the tables' documents and conversations as files and archives, inventoried and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge import staging
from folioforge.functions import paths
from folioforge.operators import probe
from folioforge.plans.adapters import table
from folioforge.plans.trees import DOCUMENT_TREE, call_tree, document_tree
from folioforge.sources import archives, files, pages, transcripts

from .registry import query


def _shown(rows: DataFrame) -> DataFrame:
    member = F.col("rel_path").contains(paths.MEMBER)
    packed = F.col("rel_path").rlike("/pack[0-9]+[.]zip$")  # their size is the writer's affair
    return rows.select("rel_path", "top_level_folder", "extension", "detected_mime", F.when(~packed, F.col("size_bytes")).alias("size_bytes"), F.when(member, F.col("modified_time")).alias("member_time"))


_SCAN = DOCUMENT_TREE + """SELECT path AS rel_path, volume AS top_level_folder, ext AS extension, size AS size_bytes, member_time,
  CASE ext WHEN 'txt' THEN 'text/plain' WHEN 'md' THEN 'text/markdown' WHEN 'csv' THEN 'text/csv' WHEN 'pgm' THEN 'image/x-portable-graymap' WHEN 'zip' THEN 'application/zip' ELSE 'application/octet-stream' END AS detected_mime
FROM inventory"""

query("tree_inventory", _SCAN)(lambda s, d: _shown(files.scan_inventory(s, document_tree(s, d))[0]))
query("tree_first_files", f"{_SCAN} ORDER BY path LIMIT 25")(lambda s, d: _shown(files.scan_inventory(s, document_tree(s, d), max_files=25)[0]))
query(
    "tree_errors",
    DOCUMENT_TREE + """SELECT path, 'zip read error' AS error FROM files WHERE ext = 'zip' UNION ALL SELECT volume || '/lost' || doc_id, 'FileNotFoundError' FROM d WHERE doc_id % 50 = 49""",
)(lambda s, d: files.scan_inventory(s, document_tree(s, d))[1].select("path", F.substring_index("error", ":", 1).alias("error")))
query(
    "tree_hashes",
    DOCUMENT_TREE + """SELECT path AS rel_path, sha256(content) AS hash_value, sha256(encode(content)[1:100]) AS sample_hash FROM files WHERE k <> 6""",
)(lambda s, d: files.scan_files(s, document_tree(s, d), algorithm="sha256", sample_bytes=100).filter("extension <> 'pgm' and not rel_path rlike '/pack[0-9]+[.]zip$'").select("rel_path", "hash_value", "sample_hash"))
query(
    "member_file_ids",
    DOCUMENT_TREE + """SELECT path AS rel_path, sha256(path || '|' || size || '|' || epoch(member_time::TIMESTAMPTZ)::BIGINT || '.000000') AS file_id FROM inventory WHERE member_time IS NOT NULL""",
)(lambda s, d: files.scan_inventory(s, document_tree(s, d))[0].filter("rel_path like '%::%'").select("rel_path", "file_id"))
query(
    "archive_contents",
    DOCUMENT_TREE + """SELECT archive, member, octet_length(encode(text)) AS size_bytes, sha256(text) AS sha FROM members WHERE starts_with(member, 'inner7/')""",
)(lambda s, d: archives.read_archives(s, document_tree(s, d)).filter("member like 'inner7/%' and error is null").select("archive", "member", "size_bytes", F.sha2("content", 256).alias("sha")))


def _text_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of all text files and members, and of files that are asked for and not there."""
    root = document_tree(spark, d)
    rows = files.scan_inventory(spark, root)[0]
    gone = rows.filter("extension = 'csv' or rel_path like '%::inner8/%'").select(F.concat("rel_path", F.lit(".gone")).alias("rel_path"))
    read = files.read_contents(rows.filter("extension = 'txt'").select("rel_path").unionByName(gone), root)
    unread = read.filter("error is not null").selectExpr("path", "cast(null as int) as page_num", "cast(null as string) as text", "error")
    return pages.extract_pages(read.filter("error is null")).unionByName(unread)


query(
    "tree_pages",
    DOCUMENT_TREE + """, t AS (SELECT path, content FROM files WHERE ext = 'txt' UNION ALL SELECT archive || '::' || member, text FROM members)
SELECT path, unnest(range(1, len(p) + 1))::INT AS page_num, unnest(p) AS text FROM (SELECT path, string_split(content, chr(12)) AS p FROM t)""",
)(lambda s, d: _text_pages(s, d).filter("error is null").select("path", "page_num", "text"))
query(
    "error_rollup",
    DOCUMENT_TREE + """SELECT 'FileNotFoundError' AS error, count(*) AS n FROM files WHERE ext = 'csv' HAVING count(*) > 0 UNION ALL SELECT 'KeyError', count(*) FROM members WHERE k = 8 HAVING count(*) > 0""",
)(lambda s, d: pages.error_counts(pages.errors(_text_pages(s, d))))


def _raster_pages(spark: SparkSession, d: str) -> DataFrame:
    root = document_tree(spark, d)
    return pages.extract_rasters(files.read_contents(files.scan_files(spark, root).filter("extension in ('pgm', 'md')"), root))


query(
    "tree_rasters",
    DOCUMENT_TREE + """SELECT path, page_num::INT AS page_num, upper(substr(sha256(text), CASE page_num WHEN 1 THEN 1 ELSE 25 END, CASE page_num WHEN 1 THEN 24 ELSE 8 END)) AS pixels, CASE page_num WHEN 1 THEN 4 ELSE 2 END::INT AS width, 0::INT AS font_count, 1::INT AS image_count
FROM files, (VALUES (1), (2)) v(page_num) WHERE k = 6""",
)(lambda s, d: _raster_pages(s, d).filter("error is null").select("path", "page_num", F.hex("pixels").alias("pixels"), "width", "font_count", "image_count"))
query("raster_errors", DOCUMENT_TREE + """SELECT path, 'ValueError' AS error FROM files WHERE k = 3 AND trim(text, chr(10) || chr(9) || chr(13) || ' ') <> ''""")(
    lambda s, d: pages.errors(_raster_pages(s, d)).select("path", F.substring_index("error", ":", 1).alias("error")),
)


def _media(spark: SparkSession, d: str) -> DataFrame:
    root = call_tree(spark, d)
    found = files.discover_media(files.scan_inventory(spark, root)[0])
    seconds = transcripts.durations(files.read_contents(found, root).select("path", "content"))
    return found.join(seconds, found["rel_path"] == seconds["file_path"], "left").select("rel_path", "display_name", "output_label", "duration_sec")


query(
    "tree_media",
    """SELECT CASE WHEN turn % 2 = 1 THEN 'calls/more' || conv_id || '.zip::t' || turn || '.wav' ELSE 'calls/' || conv_id || '/turn ' || turn || '.wav' END AS rel_path,
  CASE WHEN turn % 2 = 1 THEN 't' || turn || '.wav' ELSE 'turn ' || turn || '.wav' END AS display_name, CASE WHEN turn % 2 = 1 THEN 'more' || conv_id || '__t' || turn ELSE 'turn_' || turn END AS output_label,
  length(coalesce(text, '')) / 1000 AS duration_sec
FROM conversations""",
)(_media)
query(
    "extracted_paths",
    DOCUMENT_TREE + """SELECT path AS rel_path, CASE WHEN k = 9 THEN '/out/' || doc_id || '_' || substr(sha256(split_part(path, '::', 1)), 1, 8) || '/x/' || k || '.pdf' ELSE path END AS place
FROM (SELECT k, doc_id, CASE WHEN k = 9 THEN path || '::../x//./' || k || '.pdf' ELSE path END AS path FROM files)""",
)(lambda s, d: _extracted(s, d))


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    rows = files.scan_files(spark, document_tree(spark, d)).filter("not rel_path rlike '/pack[0-9]+[.]zip$'")
    rel = F.when(F.col("extension") == "zip", F.concat("rel_path", F.lit("::../x//./9.pdf"))).otherwise(F.col("rel_path"))
    return rows.select(rel.alias("rel_path")).select("rel_path", probe.member_location(F.col("rel_path"), F.lit("/out")).alias("place"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Speaker turns written as RTTM, among lines of other kinds, and read back."""
    path = f"{staging.working_folder(spark)}/trees/{uuid.uuid4().hex}.rttm"
    calls = table(spark, d, "conversations").selectExpr("concat(conv_id, '.wav') as file_path", "turn", "length(coalesce(text, '')) as n", "role")
    lines = calls.select(F.explode(F.array(F.format_string("SPEAKER %s 1 %d.250 %d.500 <NA> <NA> %s <NA> <NA>", "file_path", "turn", "n", "role"), F.format_string("SPKR-INFO %s 1 <NA> <NA> <NA> unknown %s <NA> <NA>", "file_path", "role"), F.lit(""))).alias("value"))
    lines.write.text(path)
    return transcripts.read_rttm(spark, path)


query("rttm_speakers", "SELECT conv_id || '.wav' AS file_path, count(DISTINCT role) AS num_speakers, round(sum(length(coalesce(text, '')) + 0.5), 3)::DOUBLE AS speech_sec FROM conversations GROUP BY conv_id")(
    lambda s, d: transcripts.speakers(_turns(s, d)),
)
query("rttm_lines", "SELECT 'SPEAKER ' || conv_id || '.wav 1 ' || turn || '.250 ' || length(coalesce(text, '')) || '.500 <NA> <NA> ' || role || ' <NA> <NA>' AS value FROM conversations")(
    lambda s, d: transcripts.to_rttm(_turns(s, d)),
)
