"""Connected components of an edge table, without the driver or one task holding a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise

#: A key with more than this share of all rows is heavy; so there are at most HEAVY heavy keys.
HEAVY = 1024


def join_split(rows: DataFrame, other: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``rows`` (``total`` of them at least) with one row of ``other`` for each key, without hot keys.

    other has a column ``d``, the number of rows of its key: what is heavy meets its rows by a broadcast of at
    most HEAVY rows, the rest by a shuffle in which no key has more than a HEAVY-th of the rows.
    """
    bound = max(1, total // HEAVY)
    heavy = F.broadcast(other.filter(F.col("d") > bound))
    light = other.filter(F.col("d") <= bound)
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(light, key)).drop("d")



def connected_components(edges: DataFrame) -> DataFrame:
    """(a long, b long) edges -> (node, root): root is the smallest node reachable; isolated nodes are absent.

    Alternates "large star" (hand every larger neighbour to the smallest one seen) and "small star" (hand
    every smaller neighbour to it) until the edge set stops changing, which is then one star for each
    component. Both steps pre-aggregate minima before the shuffle, so a node with a third of all edges costs
    one partial result per task, and meet their minima by join_split(); rounds grow with the logarithm of the
    longest path. Each round is written to the shared folder. Loops, repeated and null edges are ignored; no
    edges give an empty table.
    """
    now = materialise(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = _print(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("d"))
        large = materialise(join_split(both, least, "a", 2 * seen[0]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("d"))
        small = join_split(large, least, "a", seen[0]).select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b"))
        now = materialise(small.filter("a <> b").distinct(), "edges")
        before, seen = seen, _print(now)
        if before == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]
