"""Transcripts and page images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import incremental, media, raster, readiness, sketches
from folioforge.plans import adapters
from folioforge.plans import reference_sql as sql
from folioforge.plans.adapters import page_text, table

from .readiness import ready_docs
from .registry import query

#: Keywords that the queries look for.
KEYWORDS = {"payment": ("invoice", "payment", "account"), "meeting": ("meeting", "schedule", "agenda"), "general": ("with", "the", "and", "that")}
_TERMS = list(dict.fromkeys(w for own in KEYWORDS.values() for w in own))
_WORD = "[\\p{L}\\p{N}_]+"


def _hits(term: str) -> str:
    # RE2's word edges are ASCII: other letters are made word characters first
    return f"len(regexp_extract_all(regexp_replace(lower(text), '[^\\x00-\\x7F]', '_', 'g'), '\\b{term}\\b'))"


_SEGMENTS = (
    f"WITH seg AS (\n  SELECT conv_id, count(*) AS num_segments, count(DISTINCT role) AS num_speakers, sum(len(regexp_extract_all(lower(text), '{_WORD}')))::BIGINT AS word_count,\n    "
    + ",\n    ".join(f"sum(len(regexp_extract_all(text, '{p}')))::BIGINT AS {n}" for n, p in media.PATTERNS)
    + ",\n    "
    + ",\n    ".join(f"bool_or(regexp_matches(lower(text), '{p}')) AS hint_{n}" for n, p in media.HINTS)
    + ",\n    "
    + ",\n    ".join(f"sum({_hits(w)})::BIGINT AS kw_{w}" for w in _TERMS)
    + "\n  FROM conversations GROUP BY 1)\n"
)
_HINTS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN hint_{n} THEN '{n}' END" for n, _ in media.HINTS) + "], lambda x: x IS NOT NULL), ',') AS structure_hints"
_TOP = "array_to_string(list_transform(list_sort(list_filter([" + ", ".join(f"{{'n': -kw_{w}, 'i': {i}, 'w': '{w}'}}" for i, w in enumerate(_TERMS)) + "], lambda k: k.n < 0))[:5], lambda k: k.w), ',') AS top_keywords"
_COUNTS = "conv_id, num_segments, num_speakers, word_count, " + ", ".join(n for n, _ in media.PATTERNS)


def _shown(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.array_join(c, ",") for c in ("structure_hints", "top_keywords")})


query("media_features", _SEGMENTS + f"SELECT {_COUNTS}, {_HINTS}, " + ", ".join(f"{' + '.join(f'kw_{w}' for w in own)} AS category_{c}" for c, own in KEYWORDS.items()) + f", {_TOP} FROM seg")(
    lambda s, d: _shown(media.features(table(s, d, "conversations"), KEYWORDS)),
)
query("media_features_without_keywords", _SEGMENTS + f"SELECT {_COUNTS}, {_HINTS}, '' AS top_keywords FROM seg")(lambda s, d: _shown(media.features(table(s, d, "conversations"))))
query("media_index", _SEGMENTS + "SELECT CASE WHEN word_count >= 200 THEN 'processed' ELSE 'skipped' END AS status, count(*) AS n FROM seg GROUP BY 1")(
    lambda s, d: incremental.status_counts(media.features(table(s, d, "conversations")).select(F.when(F.col("word_count") >= 200, "processed").otherwise("skipped").alias("status"))),
)
query("transcripts", "SELECT conv_id, string_agg(role || ': ' || trim(text), chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY 1")(
    lambda s, d: media.transcript_text(table(s, d, "conversations")),
)

# An 8 x 8 page as a list: row r and column c (from 0) are element 8 r + c + 1. The middle 70 % are rows and columns 1 to 5.
_ROWS = ["ink[{}:{}]".format(8 * r + 1, 8 * r + 8) for r in range(8)]
_COLUMNS = ["[" + ", ".join(f"ink[{8 * r + c + 1}]" for r in range(8)) + "]" for c in range(8)]


def _at(r: int, c: int) -> str:
    return f"g[8 * (i // 6 + {r}) + i % 6 + {c} + 1]"


_GX = f"({_at(0, 2)} + 2 * {_at(1, 2)} + {_at(2, 2)} - {_at(0, 0)} - 2 * {_at(1, 0)} - {_at(2, 0)})"
_GY = f"({_at(2, 0)} + 2 * {_at(2, 1)} + {_at(2, 2)} - {_at(0, 0)} - 2 * {_at(0, 1)} - {_at(0, 2)})"
_MIDDLE = ", ".join(f"g[{8 * r + 2}:{8 * r + 6}]" for r in range(1, 6))
_RASTER = f"""px AS (
  SELECT (vec_id // 4)::BIGINT AS doc_id, (vec_id % 4 + 1)::INT AS page_num, label, list_transform(embedding, lambda v: least(greatest(floor((v::DOUBLE + 0.5) * 255), 0), 255)) AS g FROM embeddings),
px2 AS (SELECT *, list_concat({_MIDDLE}) AS mid FROM px),
stat AS (
  SELECT *, list_avg(g) AS gray_mean, list_aggregate(g, 'stddev_pop') AS gray_std, list_aggregate(g, 'median') AS gray_median, list_aggregate(g, 'quantile_cont', 0.1) AS gray_p10,
    list_aggregate(g, 'quantile_cont', 0.25) AS gray_p25, list_aggregate(g, 'quantile_cont', 0.75) AS gray_p75, list_aggregate(g, 'quantile_cont', 0.9) AS gray_p90,
    list_aggregate(mid, 'quantile_cont', 0.1) AS mid_p10, list_aggregate(g, 'entropy') AS histogram_entropy
  FROM px2),
part AS (
  SELECT *, len(list_filter(g, lambda v: v <= 40)) / 64 AS fixed_full, len(list_filter(mid, lambda v: v <= 40)) / 25 AS fixed_center,
    len(list_filter(g, lambda v: v <= floor(gray_p10))) / 64 AS adapt_full, len(list_filter(mid, lambda v: v <= floor(mid_p10))) / 25 AS adapt_center
  FROM stat),
dark AS (
  SELECT *, greatest(fixed_full, fixed_center) AS black_ratio_fixed, greatest(adapt_full, adapt_center) AS black_ratio_adapt,
    CASE WHEN adapt_center >= adapt_full THEN mid_p10 ELSE gray_p10 END AS black_threshold_adapt
  FROM part),
bl AS (
  SELECT *, black_ratio_fixed >= 0.9 OR (black_ratio_fixed >= 0.02 AND gray_std >= 30) OR (gray_median <= 90 AND gray_std <= 12) AS is_mostly_black FROM dark),
level AS (SELECT doc_id, page_num, v, count(*) AS c FROM (SELECT doc_id, page_num, unnest(g) AS v FROM px) GROUP BY ALL),
cum AS (
  SELECT doc_id, page_num, v, sum(c) OVER w AS below, sum(c * v) OVER w AS mass, sum(c) OVER a AS total, sum(c * v) OVER a AS whole FROM level
  WINDOW w AS (PARTITION BY doc_id, page_num ORDER BY v), a AS (PARTITION BY doc_id, page_num)),
otsu AS (
  SELECT doc_id, page_num, arg_min(v, (-between_parts, v)) AS t
  FROM (SELECT *, below * (total - below) * (mass / below - (whole - mass) / (total - below)) ** 2 AS between_parts FROM cum WHERE below < total) GROUP BY ALL),
edges AS (SELECT doc_id, page_num, avg(CASE WHEN sqrt({_GX} ** 2 + {_GY} ** 2) > 50 THEN 1 ELSE 0 END) AS edge_density FROM (SELECT doc_id, page_num, g, unnest(range(36)) AS i FROM px) GROUP BY ALL),
inked AS (SELECT doc_id, page_num, coalesce(t, 0)::DOUBLE AS otsu_threshold, list_transform(g, lambda v: CASE WHEN v <= coalesce(t, 0) THEN 1 ELSE 0 END) AS ink FROM px LEFT JOIN otsu USING (doc_id, page_num)),
feat AS (
  SELECT doc_id, page_num, ((label % 4) > 0)::INT::DOUBLE AS font_present, (label % 4)::DOUBLE AS font_count, ((label % 2) > 0)::INT::DOUBLE AS image_present, (label % 2)::DOUBLE AS image_count,
    gray_mean, gray_std, gray_median, gray_p10, gray_p90, histogram_entropy, edge_density, otsu_threshold, list_avg(ink) AS binarized_ratio,
    list_aggregate([{", ".join(f"list_sum({r})" for r in _ROWS)}], 'var_pop') AS projection_var_row, list_aggregate([{", ".join(f"list_sum({c})" for c in _COLUMNS)}], 'var_pop') AS projection_var_col
  FROM stat JOIN edges USING (doc_id, page_num) JOIN inked USING (doc_id, page_num))
"""
_METRICS = ("gray_mean", "gray_median", "gray_p10", "gray_p25", "gray_p75", "gray_std", "black_ratio_fixed", "black_ratio_adapt", "black_threshold_adapt")
query("darkness_metrics", f"WITH {_RASTER} SELECT doc_id, page_num, {', '.join(f'round({c}, 6) AS {c}' for c in _METRICS)}, is_mostly_black FROM bl")(
    lambda s, d: raster.page_darkness(adapters.rasters(s, d)).select("doc_id", "page_num", *(F.round(c, 6).alias(c) for c in _METRICS), "is_mostly_black"),
)
query(
    "darkness_docs",
    f"""WITH {_RASTER} SELECT doc_id, count(*) AS page_count, count(*) AS pages_black_checked, count(*) FILTER (WHERE is_mostly_black) AS pages_mostly_black,
    round(count(*) FILTER (WHERE is_mostly_black) / count(*), 6) AS mostly_black_pct, round(avg(black_ratio_fixed), 6) AS black_ratio_avg, round(avg(gray_median), 6) AS gray_median_avg,
    round(median(gray_median), 6) AS gray_median_p50
  FROM bl GROUP BY 1""",
)(lambda s, d: raster.darkness_docs(raster.page_darkness(adapters.rasters(s, d))))
query(
    "pages_with_darkness",
    sql.READY.rstrip()
    + f""", {_RASTER} SELECT r.doc_id, r.page_num, r.has_text, round(black_ratio_fixed, 6) AS black_ratio_fixed, round(gray_median, 6) AS gray_median, is_mostly_black
  FROM rpages r LEFT JOIN bl USING (doc_id, page_num)""",
)(lambda s, d: _dark_pages(s, d))


def _dark_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = raster.with_darkness(readiness.pages(page_text(spark, d)), raster.page_darkness(adapters.rasters(spark, d)))
    return rows.select("doc_id", "page_num", "has_text", F.round("black_ratio_fixed", 6).alias("black_ratio_fixed"), F.round("gray_median", 6).alias("gray_median"), "is_mostly_black")


def features(spark: SparkSession, d: str) -> DataFrame:
    return raster.doc_features(raster.page_feature_table(adapters.rasters(spark, d)))


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in rows.dtypes))


_ROLLED = ", ".join(f"round(avg({n}), 9) AS {n}_mean, round(median({n}), 9) AS {n}_median" for n in raster.FEATURES)
query("doc_features", f"WITH {_RASTER}, f AS (SELECT doc_id, count(*) AS pages_sampled, {_ROLLED} FROM feat GROUP BY 1) SELECT *, {', '.join(f'{n} AS {a}' for a, n in raster.ALIASES)} FROM f")(
    lambda s, d: _rounded(features(s, d)),
)
query(
    "doc_type_features",
    sql.READY.rstrip()
    + f""", {_RASTER}, f AS (SELECT doc_id, {_ROLLED} FROM feat GROUP BY 1)
SELECT r.doc_id, r.page_count::DOUBLE AS page_count, r.pages_with_text::DOUBLE AS pages_with_text, text_coverage_pct, avg_text_chars_per_page, NULL::DOUBLE AS mostly_black_pct, gray_mean_mean, edge_density_median
  FROM rdocs r LEFT JOIN f USING (doc_id)""",
)(lambda s, d: _rounded(raster.with_probe_metrics(features(s, d), ready_docs(s, d))).select("doc_id", *raster.PROBE_METRICS, "gray_mean_mean", "edge_density_median"))


def _text_sizes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.lit("all").alias("whole"), "source", "lang", F.length(F.coalesce("text", F.lit(""))).alias("size"))


def _within(values: DataFrame, merged: DataFrame, by: str, column: str) -> DataFrame:
    """Whether each quantile of merged sketches keeps the bound."""
    errors = sketches.rank_errors(values, sketches.quantiles(merged, _SHARES), [by], column)
    return errors.select(F.col(by).alias("part"), "share", "n", (F.col("rank_error") <= sketches.RANK_ERROR).alias("within_bound"))


_SHARES = (0.1, 0.5, 0.9)


@query(
    "text_size_quantiles",
    """SELECT source AS part, share::DOUBLE AS share, count(*) AS n, true AS within_bound FROM documents, (VALUES (0.1), (0.5), (0.9)) v(share) GROUP BY ALL
UNION ALL SELECT 'all', share::DOUBLE, count(*), true FROM documents, (VALUES (0.1), (0.5), (0.9)) v(share) GROUP BY share HAVING count(*) > 0""",
)
def _text_size_quantiles(s: SparkSession, d: str) -> DataFrame:
    """Sketches of sources and languages, merged to sources, and these to the whole."""
    values = _text_sizes(s, d)
    fine = sketches.sketch(values, ["whole", "source", "lang"], "size")
    by_source = sketches.merge(fine, ["whole", "source"])
    return _within(values, by_source, "source", "size").unionByName(_within(values, sketches.merge(by_source, ["whole"]), "whole", "size"))


@query("gray_quantiles", "SELECT label::VARCHAR AS part, share::DOUBLE AS share, sum(len(embedding))::BIGINT AS n, true AS within_bound FROM embeddings, (VALUES (0.1), (0.5), (0.9)) v(share) GROUP BY ALL")
def _gray_quantiles(s: SparkSession, d: str) -> DataFrame:
    """Sketches of each vector's components, merged to those of its label."""
    values = table(s, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), F.explode("embedding").alias("x"))
    return _within(values, sketches.merge(sketches.sketch(values, ["vec_id", "label"], "x"), ["label"]), "label", "x")


@query("text_size_histogram", """SELECT source, bin::INT AS bin, true AS within_bound FROM (SELECT DISTINCT source FROM documents), range(0, 4) r(bin)""")
def _text_size_histogram(s: SparkSession, d: str) -> DataFrame:
    """Counts of four bins from sketches, held against counted ones."""
    values, edges = _text_sizes(s, d), (-1.0, 500.0, 1500.0, 4000.0, 1e9)
    merged = sketches.merge(sketches.sketch(values, ["source", "lang"], "size"), ["source"])
    at = F.when(F.col("size") <= 500, 0).when(F.col("size") <= 1500, 1).when(F.col("size") <= 4000, 2).otherwise(3)
    counted = values.groupBy("source", at.alias("bin")).agg(F.count(F.lit(1)).alias("counted"))
    found = sketches.histogram(merged, edges).join(counted, ["source", "bin"], "left")
    return found.select("source", "bin", (F.abs(F.col("values") - F.coalesce("counted", F.lit(0))) <= 2 * sketches.RANK_ERROR * F.col("n") + 1).alias("within_bound"))
