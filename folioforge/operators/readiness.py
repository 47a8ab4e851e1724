"""Text readiness of paged documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import strip


@dataclass(frozen=True)
class Thresholds:
    """Characters of a page with text; share of such pages, and their average, of a text document; share of a scan."""

    page_chars: int = 25
    text_share: float = 0.50
    scanned_share: float = 0.10
    average_chars: float = 200.0


def pages(page_text: DataFrame, at: Thresholds = Thresholds()) -> DataFrame:
    """Characters of each page without surrounding space, and whether that is text."""
    n = F.length(strip(F.coalesce("text", F.lit(""))))
    return page_text.select("doc_id", "rel_path", "page_num", n.alias("text_char_count"), (n >= at.page_chars).alias("has_text"))


def classify(share: Column, average: Column, n_pages: Column, at: Thresholds = Thresholds()) -> Column:
    return (
        F.when(F.coalesce(n_pages, F.lit(0)) == 0, "Unknown")
        .when((share >= at.text_share) & (average >= at.average_chars), "Text-based")
        .when(share < at.scanned_share, "Scanned")
        .otherwise("Mixed")
    )


def docs(page_table: DataFrame, at: Thresholds = Thresholds()) -> DataFrame:
    """Pages rolled up to documents: one shuffle, partial sums before it."""
    by = page_table.groupBy("doc_id", "rel_path").agg(
        F.count("*").alias("page_count"), F.count_if("has_text").alias("pages_with_text"), F.sum(F.col("text_char_count").cast("long")).alias("total_text_chars")
    )
    share, average = F.col("pages_with_text") / F.col("page_count"), F.col("total_text_chars") / F.col("page_count")
    return by.select(
        "doc_id", "rel_path", "page_count", "pages_with_text", "total_text_chars", F.round(average, 6).alias("avg_text_chars_per_page"), F.round(share, 6).alias("text_coverage_pct"),
        classify(share, average, F.col("page_count"), at).alias("classification"),
    )


def with_notes(doc_table: DataFrame, errors: DataFrame) -> DataFrame:
    """Documents with what went wrong with them, one after the other; empty where nothing did."""
    notes = errors.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("error")), "; ").alias("notes"))
    return doc_table.join(notes, "doc_id", "left").withColumn("notes", F.coalesce("notes", F.lit("")))


def heuristic(classification: Column) -> Column:
    return F.when(classification == "Text-based", "TEXT_PDF").when(classification == "Scanned", "IMAGE_PDF").when(classification == "Mixed", "MIXED_PDF")


def summary(doc_table: DataFrame) -> DataFrame:
    """Documents and pages by class, with the share of documents and the pages that need recognition."""
    by = doc_table.groupBy("classification").agg(F.count("*").alias("docs"), F.sum("page_count").alias("pages"), F.sum("pages_with_text").alias("with_text"))
    return by.select(
        "classification", "docs", "pages", "with_text", F.greatest(F.col("pages") - F.col("with_text"), F.lit(0)).alias("without_text"),
        F.round(F.col("docs") / F.sum("docs").over(Window.partitionBy()) * 100, 6).alias("pct_docs"),
    )


def least_text(doc_table: DataFrame, n: int = 20) -> DataFrame:
    return doc_table.orderBy("text_coverage_pct", "total_text_chars", "doc_id").limit(n).select("doc_id", "text_coverage_pct", "total_text_chars")
