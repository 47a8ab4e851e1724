"""What of an inventory is probed, and what is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import paths


def candidates(inv: DataFrame, top_folder: str | None = None) -> DataFrame:
    """PDFs (of one folder) with their document id; archive and member apart."""
    rows = inv.filter(F.lower(F.coalesce("extension", F.lit(""))) == "pdf")
    if top_folder is not None:
        rows = rows.filter(F.col("top_level_folder") == top_folder)
    at = F.instr("rel_path", paths.MEMBER)
    return rows.select(
        paths.stable_doc_id(F.col("hash_value"), F.col("rel_path"), F.col("size_bytes"), F.col("modified_time")).alias("doc_key"), "rel_path", "top_level_folder",
        F.when(at > 0, F.substring("rel_path", F.lit(1), at - 1)).alias("archive"), F.when(at > 0, F.substring("rel_path", at + 2, F.length("rel_path"))).alias("member"),
    )


def ignored_counts(inv: DataFrame) -> DataFrame:
    """Files that are no PDFs, by extension and by media type, in one pass."""
    rest = inv.filter(F.lower(F.coalesce("extension", F.lit(""))) != "pdf").select(F.coalesce("extension", F.lit("")).alias("ext"), F.coalesce("detected_mime", F.lit("")).alias("mime"))
    by = rest.groupingSets([[F.col("ext")], [F.col("mime")]], "ext", "mime").agg(F.grouping_id().alias("g"), F.count("*").alias("files"))
    return by.select(F.when(F.col("g") == 1, "extension").otherwise("mime").alias("level"), F.coalesce("ext", "mime").alias("value"), "files")


def select_listed(rows: DataFrame, selection: DataFrame) -> DataFrame:
    """The rows listed by path, or else by document id."""
    if "rel_path" in selection.columns:
        listed = selection.select(paths.normalize_rel_path(F.col("rel_path")).alias("listed")).distinct()
        return rows.join(listed, paths.normalize_rel_path(rows["rel_path"]) == F.col("listed"), "left_semi")
    if "doc_id" in selection.columns:
        listed = selection.select(F.col("doc_id").cast("string").alias("listed")).distinct()
        return rows.join(listed, rows["doc_id"].cast("string") == F.col("listed"), "left_semi")
    raise ValueError("a selection has rel_path or doc_id")


def sanitized_label(label):
    """A label fit for file names: other characters than letters, digits, dots and hyphens become underscores."""
    return F.regexp_replace(F.regexp_replace(F.trim(label), "[^A-Za-z0-9.-]+", "_"), "^_+|_+$", "")


def output_label(name):
    """A label for a recording's output: each character that is no letter, digit, hyphen or underscore becomes one."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(name), r"(?U)[^\p{L}\p{N}_-]", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("media_file"))


def volume_of(title):
    """VOL and five digits from "data set N" in a title; null without one."""
    n = F.regexp_extract(title, r"(?i)data\s*set\s*(\d+)", 1)
    return F.when(n != "", F.concat(F.lit("VOL"), F.lpad(n, 5, "0")))


def with_probe(pdfs: DataFrame, docs: DataFrame) -> DataFrame:
    """All PDFs with what the probe found; those that it did not read have no metrics and the class Unknown."""
    metrics = [c for c in docs.columns if c not in ("rel_path", *pdfs.columns)]
    rows = pdfs.join(docs.select("rel_path", *metrics), "rel_path", "left")
    return rows.withColumn("classification", F.coalesce("classification", F.lit("Unknown"))) if "classification" in metrics else rows


def for_scan(probe_docs: DataFrame, pdfs: DataFrame) -> DataFrame:
    """Probed documents with the file to scan: id and folder from the inventory where the probe lacks them, and the
    path of an extracted member before the file's own.
    """
    files = pdfs.select("rel_path", *(F.col(c).alias(f"file_{c}") for c in ("doc_id", "top_level_folder", "probe_path", "abs_path")))
    rows = probe_docs.join(files, "rel_path", "left")
    kept = [c for c in probe_docs.columns if c not in ("doc_id", "top_level_folder")]
    folder = F.col("top_level_folder") if "top_level_folder" in probe_docs.columns else F.lit(None)
    return rows.select(
        *kept, F.coalesce(F.col("doc_id").cast("string"), F.col("file_doc_id").cast("string")).alias("doc_id"), F.coalesce(folder, "file_top_level_folder").alias("top_level_folder"),
        F.coalesce("file_probe_path", "file_abs_path").alias("scan_path"),
    )


def scan_errors(candidates: DataFrame) -> DataFrame:
    """What cannot be scanned: documents without a file, as errors by path."""
    return candidates.filter(F.coalesce("scan_path", F.lit("")) == "").select("rel_path", F.lit("missing scan path").alias("error"))


def member_location(rel_path, extract_root):
    """Where a file, or a member extracted from an archive, lies: below extract_root, in the archive's own folder."""
    at = F.instr(rel_path, paths.MEMBER)
    archive, member = F.substring(rel_path, F.lit(1), at - 1), F.substring(rel_path, at + 2, F.length(rel_path))
    inside = F.concat_ws("/", extract_root, paths.extract_folder(archive), paths.safe_member_path(member))
    return F.when(at > 0, inside).otherwise(rel_path)
