"""Quantiles by mergeable sketches, beside the exact ones.

A KLL sketch holds a bounded sample of a group's values and is merged without loss of its bound: sketches of pages become
those of documents, of folders and of runs, with no value read again. An exact median has to hold all values of
a group in one task; a sketch takes some kilobytes whatever the group. Its error is one of rank: what it gives for a
share q is the value of some share within RANK_ERROR of q. Groups of fewer values than K are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items of a sketch's lowest level, and the error of rank that it keeps in all but one of a thousand cases.
K, RANK_ERROR = 800, 0.01


def sketch(rows: DataFrame, by: list[str], column: str, k: int = K) -> DataFrame:
    """A sketch of a column for each group, and n, the values in it; nulls and NaN are left out, groups of nothing else too."""
    value = F.col(column).cast("double")
    kept = rows.filter(value.isNotNull() & ~F.isnan(value)).select(*by, value.alias("value"))
    return kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("value", k).alias("sketch"))


def merge(sketches: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """Sketches of finer groups as those of coarser ones."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def quantiles(sketches: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """A row for each group and share with the value there."""
    found = F.array(*(F.struct(F.lit(float(q)).alias("share"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias("value")) for q in shares))
    kept = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*kept, F.inline(found))


def histogram(sketches: DataFrame, edges: tuple[float, ...]) -> DataFrame:
    """About how many values of each group lie in each bin above one edge and up to the next, to the nearest whole."""
    below = [F.kll_sketch_get_rank_double("sketch", F.lit(float(e))) for e in edges]
    ranks = sketches.withColumn("below", F.array(*below))
    bins = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(len(edges) - 2)), lambda i: F.round((F.col("below")[i + 1] - F.col("below")[i]) * F.col("n")).cast("long")))
    kept = [c for c in sketches.columns if c != "sketch"]
    return ranks.select(*kept, bins.alias("bin", "values"))


def rank_errors(values: DataFrame, found: DataFrame, by: list[str], column: str) -> DataFrame:
    """How far each quantile found is from its share: 0 if the value takes up the share, else the gap of ranks.

    ``by`` names at least one column; groups of a null are left out. The values of each group meet its few quantiles.
    """
    value: Column = F.col(column).cast("double")
    rows = values.filter(value.isNotNull() & ~F.isnan(value)).select(*by, value.alias("own"))
    joined = rows.join(found.drop("n"), by)
    counts = joined.groupBy(*by, "share", "value").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("own") < F.col("value")).alias("less"), F.count_if(F.col("own") <= F.col("value")).alias("up_to"))
    low, high = F.col("less") / F.col("n"), F.col("up_to") / F.col("n")
    return counts.select(*by, "share", "n", F.greatest(low - F.col("share"), F.col("share") - high, F.lit(0.0)).alias("rank_error"))
