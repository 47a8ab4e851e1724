"""Inventory rollups and quality reports: pure DataFrame functions, no actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import paths

#: Edges of the size histogram in bytes (the last bin is open).
SIZE_EDGES = (0, 1024, 10_000, 100_000, 1_000_000, 10_000_000, 100_000_000, 1_000_000_000)
#: Extensions that are nothing unusual.
COMMON_EXTENSIONS = (
    "pdf", "txt", "csv", "tsv", "log", "md", "json", "xml", "html", "jpg", "jpeg", "png", "gif",
    "tif", "tiff", "bmp", "heic", "mp3", "wav", "mp4", "mov", "avi", "zip", "gz", "tar",
)
LARGE_FILE = 500 * 1024 * 1024


def summary(inv: DataFrame) -> DataFrame:
    """Files and bytes in total and by extension, media type and folder, in one pass over the table."""
    return (
        inv.groupingSets([[], [F.col("extension")], [F.col("detected_mime")], [F.col("top_level_folder")]], "extension", "detected_mime", "top_level_folder")
        .agg(F.grouping_id().alias("g"), F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
        .select(
            F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "extension").when(F.col("g") == 5, "mime").otherwise("folder").alias("level"),
            F.coalesce("extension", "detected_mime", "top_level_folder", F.lit("")).alias("value"), "files", "bytes",
        )
    )


def folder_rollup(inv: DataFrame) -> DataFrame:
    """Files, bytes and the share of all bytes by folder; the whole counts as 1 when it is empty."""
    by = inv.groupBy("top_level_folder").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    whole = F.greatest(F.sum("bytes").over(Window.partitionBy()), F.lit(1))
    return by.select("top_level_folder", "files", "bytes", F.round(F.col("bytes") / whole * 100, 6).alias("pct_bytes"))


def ext_mime_counts(inv: DataFrame) -> DataFrame:
    return inv.filter("extension is not null and detected_mime is not null").groupBy("extension", "detected_mime").agg(F.count("*").alias("files"))


def size_histogram(inv: DataFrame) -> DataFrame:
    """Counts in half-open bins; empty bins are zero."""
    edges = F.array(*(F.lit(e).cast("long") for e in SIZE_EDGES))
    counted = inv.filter("size_bytes >= 0").groupBy(F.size(F.filter(edges, lambda e: e <= F.col("size_bytes"))).alias("bin")).agg(F.count("*").alias("files"))
    bins = inv.sparkSession.range(1, len(SIZE_EDGES) + 1).select(F.col("id").cast("int").alias("bin"), edges[F.col("id").cast("int") - 1].alias("from_bytes"))
    return F.broadcast(bins).join(counted, "bin", "left").select("bin", "from_bytes", F.coalesce("files", F.lit(0)).alias("files"))


def largest_files(inv: DataFrame, n: int = 20) -> DataFrame:
    return inv.select("rel_path", "size_bytes").orderBy(F.desc("size_bytes"), "rel_path").limit(n)


def deepest_paths(inv: DataFrame, n: int = 20) -> DataFrame:
    """Folders by depth, then by files."""
    folder = paths.parent(F.col("rel_path"))
    by = inv.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"))
    return by.withColumn("depth", paths.depth(F.col("folder"))).orderBy(F.desc("depth"), F.desc("files"), "folder").limit(n)


def executive_summary(inv: DataFrame) -> DataFrame:
    category = paths.file_category(F.col("extension"), F.col("detected_mime"))
    counts = [F.count_if(category == k).alias(f"n_{k}") for k in ("pdf", "text", "csv", "image", "other")]
    return inv.agg(F.count("*").alias("files"), F.round(F.sum("size_bytes") / 1024.0**3, 9).alias("gib"), F.countDistinct("top_level_folder").alias("folders"), *counts)


def file_categories(inv: DataFrame) -> DataFrame:
    return inv.groupBy(paths.file_category(F.col("extension"), F.col("detected_mime")).alias("category")).agg(F.count("*").alias("files"))


def ext_by_folder(inv: DataFrame, top: int = 12) -> DataFrame:
    """Extension by folder counts of the most frequent extensions."""
    by = inv.groupBy("extension", "top_level_folder").agg(F.count("*").alias("files"))
    best = by.groupBy("extension").agg(F.sum("files").alias("n")).orderBy(F.desc("n"), "extension").limit(top).select("extension")
    return by.join(F.broadcast(best), "extension", "left_semi")  # at most ``top`` rows


def duplicate_groups(inv: DataFrame, examples: int = 3) -> DataFrame:
    """Groups of two and more files with one content hash (without one: one path), with their first paths.

    Minima are combined before the shuffle; a group's paths are never gathered as a whole.
    """
    key = F.coalesce(F.nullif(F.trim("hash_value"), F.lit("")), F.col("rel_path"))
    keyed = inv.select(key.alias("dup_key"), "rel_path", "size_bytes")
    groups = keyed.groupBy("dup_key").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes")).filter("n >= 2")
    place = F.row_number().over(Window.partitionBy("dup_key").orderBy("rel_path"))
    first = keyed.join(groups.select("dup_key"), "dup_key", "left_semi").withColumn("k", place).filter(F.col("k") <= examples)
    shown = first.groupBy("dup_key").agg(F.array_join(F.array_sort(F.collect_list("rel_path")), "|").alias("example_paths"))
    return groups.join(shown, "dup_key").select("dup_key", "n", "bytes", "example_paths")


def potential_issues(inv: DataFrame, now, large: int = LARGE_FILE) -> DataFrame:
    """Files with at least one flag, flags in a fixed order."""
    mime = F.lower(F.trim(F.coalesce("detected_mime", F.lit(""))))
    flags = (
        ("zero_size", F.col("size_bytes") == 0),
        ("missing_mime", mime.isin("", "unknown", "application/octet-stream")),
        ("very_large", F.col("size_bytes") >= large),
        ("uncommon_extension", ~F.lower(F.coalesce("extension", F.lit(""))).isin(*COMMON_EXTENSIONS)),
        ("future_modified_time", paths.parse_utc(F.col("modified_time")) > now),
    )
    issues = F.array_join(F.filter(F.array(*(F.when(c, n) for n, c in flags)), lambda x: x.isNotNull()), ", ")
    return inv.withColumn("issues", issues).filter("issues <> ''").select("rel_path", "size_bytes", "issues")
