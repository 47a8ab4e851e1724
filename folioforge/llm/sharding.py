"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows of one group (equal texts) go to one shard. Groups in falling order of size enter the open shard with the
least room that holds them, found in a balanced tree of remaining capacities; the fixed capacity is the smallest
for which that ends within the shards asked for. Groups larger than an even share get shards of their own first.

A group's shard depends on its size and its rank among groups of that size only, so the packing runs over the
histogram of group sizes: of equal groups, those that follow each other go to the same shard while they fit, since
the shard just filled has the least room. Distinct sizes number at most 2 * sqrt(total bytes), whatever the number
of groups: those up to the root are no more than it, and no more than the root many groups can be larger.
Ranks come from counts of each part of the table: no task sees all groups of a size or all rows of a shard.
"""

from __future__ import annotations

import bisect
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialise, only_result

#: A group of more than this share of all rows is dealt by a broadcast of at most so many groups.
HEAVY = 4096


class Rooms:
    """Bins by remaining capacity: a tree of sorted blocks that split as they fill."""

    BLOCK = 64

    def __init__(self) -> None:
        self.blocks: list[list[tuple[int, int]]] = [[]]

    def add(self, room: int, which: int) -> None:
        at = max(0, bisect.bisect_right([b[0] if b else (0, 0) for b in self.blocks], (room, which)) - 1)
        block = self.blocks[at]
        bisect.insort(block, (room, which))
        if len(block) > self.BLOCK:
            half = len(block) // 2
            self.blocks[at : at + 1] = [block[:half], block[half:]]

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the least room of at least size."""
        for at in range(max(0, bisect.bisect_right([b[-1] if b else (-1, 0) for b in self.blocks], (size, -1))), len(self.blocks)):
            block = self.blocks[at]
            if (i := bisect.bisect_left(block, (size, -1))) < len(block):
                found = block.pop(i)
                if not block and len(self.blocks) > 1:
                    del self.blocks[at]
                return found
        return None


def best_fit_decreasing(runs: list[tuple[int, int]], capacity: int, most: int) -> list[list[tuple[int, int]]] | None:
    """(size, groups) runs in falling order of size -> for each run, (shard, groups put there) in order.

    None if more than ``most`` bins of the capacity were needed.
    """
    rooms, opened, out = Rooms(), 0, []
    for size, count in runs:
        line: list[tuple[int, int]] = []
        while count:
            if (found := rooms.take(size)) is None:
                if opened == most or size > capacity:
                    return None
                found = (capacity, opened)
                opened += 1
            room, which = found
            # what is left in this bin is the least room that holds another group of this size, if it holds one
            put = min(count, room // size)
            rooms.add(room - put * size, which)
            line.append((which, put))
            count -= put
        out.append(line)
    return out


def pack_bins(histogram: dict[int, int], bins: int) -> list[tuple[int, int, int]]:
    """Groups by size -> (size, first rank among its size, bin) lines, by best-fit-decreasing under the least
    capacity found that needs no more than ``bins``. Groups above an even share of what is left go first, one to
    a bin. Where groups are few and coarse, best fit leaves its last bins low; levelling then moves single groups.
    """
    runs = sorted(histogram.items(), reverse=True)
    held: list[Counter] = [Counter() for _ in range(bins)]
    alone, total = 0, sum(size * n for size, n in runs)
    while runs and alone < bins - 1 and runs[0][0] * (bins - alone) > total:
        size, n = runs[0]
        held[alone][size] = 1
        total -= size
        alone += 1
        runs = [(size, n - 1)] * (n > 1) + runs[1:]
    if runs:
        left = bins - alone
        low = high = max(-(-total // left), runs[0][0])
        while (best := best_fit_decreasing(runs, high, left)) is None:
            low, high = high + 1, high + max(1, high // 64)
        while low < high:
            middle = (low + high) // 2
            if (found := best_fit_decreasing(runs, middle, left)) is None:
                low = middle + 1
            else:
                high, best = middle, found
        for (size, _), line in zip(runs, best, strict=True):
            for which, put in line:
                held[alone + which][size] += put
        _level(held[alone:])
    out, rank = [], Counter()
    for which, own in enumerate(held):
        for size, n in own.items():
            if n:
                out.append((size, rank[size], which))
                rank[size] += n
    return out


def _level(held: list[Counter]) -> None:
    """While the fullest bin has a group smaller than its lead over the emptiest, hand the nearest to half over."""
    load = [sum(size * n for size, n in own.items()) for own in held]
    while True:
        top, low = max(range(len(load)), key=load.__getitem__), min(range(len(load)), key=load.__getitem__)
        lead = load[top] - load[low]
        size = min((s for s, n in held[top].items() if n and s < lead), key=lambda s: abs(2 * s - lead), default=None)
        if size is None:
            return
        held[top][size] -= 1
        held[low][size] += 1
        load[top] -= size
        load[low] += size


def _ranked(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with ``place``: numbers from 0 without gaps among rows of a key, in order of part, then ``order``."""
    counts = rows.groupBy(key, "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(key, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy(key, "part").orderBy(order)) - 1
    return rows.withColumn("place", place).join(base, [key, "part"]).withColumn("place", F.col("base") + F.col("place")).drop("base")


@only_result
def shard_documents(docs: DataFrame, *, shards: int = 24, overhead: int = 8, keep: tuple[str, ...] = ()) -> DataFrame:
    """Deal documents to shards of nearly equal bytes; equal texts stay together.

    docs: doc_id and text; of other columns those in ``keep`` are carried along. A row's size is its text's UTF-8
    bytes plus ``overhead``; a null text has none, and null texts are one group. Returns doc_id, the kept columns,
    size, text_crc32, shard (from 0) and slot (gapless from 0 in each shard). Of groups of one size, any may go to
    any of that size's places. A group above an even share has a shard of its own, and the others share the rest.
    Repeated rows and null ids are rows like any other. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    carried = [F.col(c).alias(f"__keep_{i}") for i, c in enumerate(keep)]
    rows = docs.select(
        "doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(F.concat(F.when(F.col("text").isNull(), "n").otherwise("t"), text).cast("binary"))).alias("text_key"),
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), *carried,
    )
    rows = materialise(rows, "rows")
    groups = rows.groupBy("text_key").agg(F.sum("size").alias("bytes"), F.count("*").alias("members"), F.min("part").alias("part"))
    groups = materialise(groups, "groups")
    sums = groups.groupBy("bytes").agg(F.count("*").alias("n")).toArrow()  # at most 2 * sqrt(total) rows
    lines = sorted(pack_bins(dict(zip(sums.column(0).to_pylist(), sums.column(1).to_pylist(), strict=True)), shards))
    cuts: dict[int, list[dict]] = {}
    for size, rank, which in lines:
        cuts.setdefault(size, []).append({"first": rank, "shard": which})
    schema = pa.schema([("bytes", pa.int64()), ("cuts", pa.list_(pa.struct([("first", pa.int64()), ("shard", pa.int32())])))])
    # joined by Spark's choice: the table's size is known, and it is broadcast only if small
    plan = spark.createDataFrame(pa.table({"bytes": list(cuts), "cuts": list(cuts.values())}, schema=schema))
    placed = _ranked(groups, "bytes", "text_key").join(plan, "bytes")
    of_group = F.element_at(F.filter("cuts", lambda c: c["first"] <= F.col("place")), -1)["shard"]
    placed = materialise(placed.select("text_key", "members", of_group.alias("shard")), "placed")
    # groups of many rows, HEAVY at most, meet their rows by broadcast; the others by a shuffle without large keys
    bound = rows.count() // HEAVY
    heavy = F.broadcast(placed.filter(F.col("members") > bound).select("text_key", "shard"))
    light = placed.filter(F.col("members") <= bound).select("text_key", "shard")
    dealt = rows.join(heavy, "text_key").unionByName(rows.join(heavy, "text_key", "left_anti").join(light, "text_key"))
    kept = [F.col(f"__keep_{i}").alias(c) for i, c in enumerate(keep)]
    return _ranked(dealt, "shard", "row").select("doc_id", *kept, "size", "text_crc32", "shard", F.col("place").alias("slot"))


def write_shards(docs: DataFrame, path: str, *, shards: int = 24) -> None:
    """Shard documents and write each row, all its columns, with its slot: a folder of Parquet files a shard.

    Rows are dealt as shard_documents() does, without its result written apart; columns of docs named like its results are written as theirs.
    """
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "size", "text_crc32", "shard", "slot"))
    shard_documents.__wrapped__(docs, shards=shards, keep=keep).write.partitionBy("shard").parquet(path)
