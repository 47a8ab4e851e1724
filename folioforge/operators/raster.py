"""Kernels on gray page images: one Arrow batch of pages at a time, numbers out; and their rollups to documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Darkness:
    """Bounds of the darkness rules."""

    dark: int = 40
    mostly: float = 0.90
    percentile: float = 10.0
    median: float = 90.0
    least_dark: float = 0.02
    contrast: float = 30.0
    flat: float = 12.0
    crop: float = 0.70


#: Features of a page, and what pages of no pixels still have.
OBJECTS = ("font_present", "font_count", "image_present", "image_count")
PIXELS = (
    "gray_mean", "gray_std", "gray_median", "gray_p10", "gray_p90", "histogram_entropy", "edge_density",
    "otsu_threshold", "binarized_ratio", "projection_var_row", "projection_var_col",
)
FEATURES = OBJECTS + PIXELS
#: Darkness metrics of a page.
DARKNESS = (
    "gray_mean", "gray_median", "gray_p10", "gray_p25", "gray_p75", "gray_std", "black_ratio_fixed_full", "black_ratio_fixed_center", "black_ratio_fixed",
    "black_ratio_adapt_full", "black_ratio_adapt_center", "black_ratio_adapt", "black_threshold_adapt_full", "black_threshold_adapt_center", "black_threshold_adapt",
)


def edge_density(gray: np.ndarray, bound: float = 50.0) -> float:
    """Share of inner pixels whose Sobel gradient exceeds the bound; undefined below 3 x 3."""
    if min(gray.shape) < 3:
        return float("nan")
    g = gray.astype(np.float64)
    rows = g[:-2] + 2 * g[1:-1] + g[2:]
    columns = g[:, :-2] + 2 * g[:, 1:-1] + g[:, 2:]
    return float((np.hypot(rows[:, 2:] - rows[:, :-2], columns[2:] - columns[:-2]) > bound).mean())


def otsu_threshold(gray: np.ndarray) -> int:
    """The level that separates the histogram with the largest variance between its parts; the first of several."""
    histogram = np.bincount(gray.ravel(), minlength=256).astype(np.float64)
    below = np.cumsum(histogram)
    mass = np.cumsum(histogram * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.argmax(np.where((below > 0) & (above > 0), between, -1.0))) if (above > 0).any() and (below[above > 0] > 0).any() else 0


def entropy(gray: np.ndarray) -> float:
    p = np.bincount(gray.ravel(), minlength=256) / gray.size
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def page_features(gray: np.ndarray) -> dict[str, float]:
    """The features that pixels give, by the names in PIXELS."""
    level = otsu_threshold(gray)
    ink = gray <= level
    low, high = np.percentile(gray, (10, 90))
    return dict(
        zip(
            PIXELS,
            (
                float(gray.mean()), float(gray.std()), float(np.median(gray)), float(low), float(high), entropy(gray), edge_density(gray),
                float(level), float(ink.mean()), float(ink.sum(axis=1).var()), float(ink.sum(axis=0).var()),
            ),
            strict=True,
        )
    )


def centre(gray: np.ndarray, share: float) -> np.ndarray:
    """The middle of a page: ``share`` of its height and width, rounded down, one pixel at least."""
    sizes = [max(1, int(n * share)) for n in gray.shape]
    starts = [(n - size) // 2 for n, size in zip(gray.shape, sizes, strict=True)]
    return gray[starts[0] : starts[0] + sizes[0], starts[1] : starts[1] + sizes[1]]


def darkness(gray: np.ndarray, at: Darkness = Darkness()) -> dict[str, float | bool]:
    """Dark shares of the page and its middle (fixed and relative bounds), and whether the page is mostly black."""
    if not gray.size:
        return dict.fromkeys(DARKNESS, 0.0) | {"is_mostly_black": False}
    out: dict[str, float | bool] = {"gray_mean": float(gray.mean()), "gray_std": float(gray.std())}
    for name, q in (("gray_median", 50), ("gray_p10", 10), ("gray_p25", 25), ("gray_p75", 75)):
        out[name] = float(np.percentile(gray, q))
    for part, pixels in (("full", gray), ("center", centre(gray, at.crop))):
        bound = float(np.percentile(pixels, at.percentile))
        out[f"black_ratio_fixed_{part}"] = float((pixels <= at.dark).mean())
        out[f"black_ratio_adapt_{part}"] = float((pixels <= np.floor(bound)).mean())
        out[f"black_threshold_adapt_{part}"] = bound
    for kind in ("fixed", "adapt"):
        out[f"black_ratio_{kind}"] = max(out[f"black_ratio_{kind}_full"], out[f"black_ratio_{kind}_center"])
    inner = out["black_ratio_adapt_center"] >= out["black_ratio_adapt_full"]
    out["black_threshold_adapt"] = out["black_threshold_adapt_center" if inner else "black_threshold_adapt_full"]
    fixed, std = out["black_ratio_fixed"], out["gray_std"]
    out["is_mostly_black"] = fixed >= at.mostly or (fixed >= at.least_dark and std >= at.contrast) or (out["gray_median"] <= at.median and std <= at.flat)
    return out


def _kernel(compute: Callable[[np.ndarray], dict], names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pixels, width in zip(batch.column("pixels"), batch.column("width").to_pylist(), strict=True):
                gray = np.frombuffer(pixels.as_buffer(), np.uint8) if pixels.is_valid else np.empty(0, np.uint8)
                whole = len(gray) and width and len(gray) % width == 0
                rows.append(compute(gray.reshape(-1, width)) if whole else {})
            kept = batch.drop_columns(["pixels", "width"])
            for name in names:
                kept = kept.append_column(name, pa.array([r.get(name) for r in rows], pa.bool_() if name.startswith("is_") else pa.float64()))
            yield kept

    return run


def _measured(rasters: DataFrame, keys: list[str], compute, names: tuple[str, ...]) -> DataFrame:
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rasters.select(*keys).schema)
    schema = f"{kinds}, " + ", ".join(f"{n} {'boolean' if n.startswith('is_') else 'double'}" for n in names)
    return rasters.select(*keys, "pixels", "width").mapInArrow(_kernel(compute, names), schema)


def page_darkness(rasters: DataFrame) -> DataFrame:
    """rasters: doc_id, page_num, pixels (binary, row by row), width -> the darkness metrics of each page.

    A page that could not be rendered (no pixels, or rows of another width) has null metrics.
    """
    return _measured(rasters, ["doc_id", "page_num"], darkness, (*DARKNESS, "is_mostly_black"))


def page_feature_table(rasters: DataFrame) -> DataFrame:
    """rasters with font_count and image_count -> the fifteen features of each page; null pixel features without pixels."""
    keys = ["doc_id", "page_num", "font_count", "image_count"]
    found = _measured(rasters, keys, page_features, PIXELS)
    fonts, images = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("font_count", "image_count"))
    objects = ((fonts > 0).cast("double"), fonts, (images > 0).cast("double"), images)
    return found.select("doc_id", "page_num", *(c.alias(n) for n, c in zip(OBJECTS, objects, strict=True)), *PIXELS)


def with_darkness(pages: DataFrame, dark: DataFrame) -> DataFrame:
    """A page table with the darkness metrics of the same document and page; null where a page was not rendered."""
    shown = ("black_ratio_fixed", "black_ratio_adapt", "gray_median", "gray_std", "is_mostly_black")
    return pages.join(dark.select("doc_id", "page_num", *shown), ["doc_id", "page_num"], "left")


def darkness_docs(pages: DataFrame) -> DataFrame:
    """Pages rolled up: pages, pages measured, mostly black ones and their share, mean dark share, gray medians."""
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("page_count"), F.count("is_mostly_black").alias("pages_black_checked"), F.count_if("is_mostly_black").alias("pages_mostly_black"),
        F.round(F.try_divide(F.count_if("is_mostly_black"), F.count("is_mostly_black")), 6).alias("mostly_black_pct"),
        F.round(F.coalesce(F.avg("black_ratio_fixed"), F.lit(0.0)), 6).alias("black_ratio_avg"),
        F.round(F.coalesce(F.avg("gray_median"), F.lit(0.0)), 6).alias("gray_median_avg"),
        F.round(F.coalesce(F.median("gray_median"), F.lit(0.0)), 6).alias("gray_median_p50"),
    )


def page_sample(pages: DataFrame, most: int, seed: int, key: str = "rel_path") -> DataFrame:
    """At most ``most`` pages of each document, the same ones every time: seeded by the document's path and the
    page, so that documents get pages of their own; all pages of a document that has no more.
    """
    order = F.sha2(F.concat_ws("|", F.col(key), F.col("page_num").cast("string"), F.lit(str(seed))).cast("binary"), 256)
    place = F.row_number().over(Window.partitionBy(key).orderBy(order, "page_num"))
    return pages.withColumn("place", place).filter(F.col("place") <= most).drop("place")


#: Further names of four document features.
ALIASES = (("font_present_pct", "font_present_mean"), ("avg_font_count", "font_count_mean"), ("image_present_pct", "image_present_mean"), ("avg_image_count", "image_count_mean"))
#: Probe metrics that stand beside page features.
PROBE_METRICS = ("page_count", "pages_with_text", "text_coverage_pct", "avg_text_chars_per_page", "mostly_black_pct")


def feature_names() -> list[str]:
    """The columns that a model may learn from, in order: probe metrics, means and medians, aliases."""
    return [*PROBE_METRICS, *(f"{n}_{s}" for n in FEATURES for s in ("mean", "median")), *(a for a, _ in ALIASES)]


def doc_features(pages: DataFrame) -> DataFrame:
    """Means and medians of each feature over a document's pages, undefined ones left out, and pages sampled."""
    some: list[Column] = [F.when(~F.isnan(n), F.col(n)).alias(n) for n in FEATURES]
    rolled = [f(F.col(n)).alias(f"{n}_{s}") for n in FEATURES for s, f in (("mean", F.avg), ("median", F.median))]
    by = pages.select("doc_id", *some).groupBy("doc_id").agg(F.count("*").alias("pages_sampled"), *rolled)
    return by.select("*", *(F.col(n).alias(a) for a, n in ALIASES))


def with_probe_metrics(features: DataFrame, probe_docs: DataFrame) -> DataFrame:
    """Document features with the probe's metrics of the same document; what the probe lacks is null."""
    metrics = [(F.col(n) if n in probe_docs.columns else F.lit(None)).cast("double").alias(n) for n in PROBE_METRICS]
    return probe_docs.select("doc_id", *metrics).join(features, "doc_id", "left")
