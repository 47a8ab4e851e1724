"""A kept index of text by trigrams: a search reads the pages that may hold its words, not all of them.

``pages/shelf=<n>`` holds the texts, a document's together, numbered in each block; a shelf holds one block or, in large
tables, several. ``grams/bucket=<n>`` holds for each trigram and block the numbers of the pages with it, as differences in
rising order, in one row or a few. ``counts/bucket=<n>`` holds in how many pages a trigram stands. A search looks up the counts of the trigrams it asks for, takes the rarest few, intersects
their pages block by block, and gives back those pages from their blocks alone; whether the words really stand there is
for the caller to see. Texts are folded as a search without regard to case sees them, character by character, so that no
page is missed. A search of fewer than three characters has no trigram and reads all pages.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.operators.catalogue_views import keyword_search
from folioforge.staging import staged

#: Buckets of trigrams, and how many of the rarest trigrams of a search are intersected.
BUCKETS, RAREST = 64, 4
#: Blocks up to so many are named in the plan; of more, a join finds them.
NAMED_BLOCKS = 2_000
#: Folders of pages, whatever the number of blocks, and characters whose trigrams a task sorts at once.
SHELVES, CHARACTERS = 1_024, 4_000_000


def fold(text: Column) -> Column:
    """Characters that differ in case only made alike, each by itself: no final sigma, no dotted capital i.

    Both cases are needed, since some letters share one of them only; what stands between keeps the optimizer from
    taking the two for one.
    """
    upper = F.upper(F.replace(text, F.lit("İ"), F.lit("i")))
    return F.replace(F.lower(F.replace(upper, F.lit("\u212a"), F.lit("K"))), F.lit("ς"), F.lit("σ"))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


_LISTS = "gram string, block int, steps array<int>, pages int"


def _lists(blocks: np.ndarray, numbers: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
    """For each trigram and block the numbers of its pages; pages come in order of block and number."""
    codes = [np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for t in texts]
    lengths = np.array([len(c) for c in codes], np.int64)
    chars = np.concatenate(codes)
    alphabet = np.flatnonzero(np.bincount(chars, minlength=1)).astype(np.int64)
    base, n = len(alphabet), len(texts)
    ranks = np.zeros(int(alphabet[-1]) + 1 if base else 1, np.int64)
    ranks[alphabet] = np.arange(base)
    r = ranks[chars]
    grams = (r[:-2] * base + r[1:-1]) * base + r[2:]
    page = np.repeat(np.arange(n), lengths)
    keys = np.unique((grams * n + page[: len(grams)])[page[:-2] == page[2:]])  # none that goes over the end of a page
    gram, page = np.divmod(keys, n)
    block, number = blocks[page], numbers[page]
    begins = np.ones(len(keys), bool)
    begins[1:] = (gram[1:] != gram[:-1]) | (block[1:] != block[:-1])
    starts = np.flatnonzero(begins)
    steps = np.where(begins, number, np.diff(number, prepend=0)).astype(np.int32)
    kinds, of = np.unique(gram[starts], return_inverse=True)
    names = ["".join(chr(alphabet[c]) for c in (k // base // base, k // base % base, k % base)) for k in kinds.tolist()]
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(keys)), pa.int32()), pa.array(steps))
    sizes = np.diff(np.append(starts, len(keys)))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(of)), pa.array(block[starts], pa.int32()), lists, pa.array(sizes, pa.int32())], ["gram", "block", "steps", "pages"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, number and folded text -> lists, of a bounded number of characters at a time, or of one page."""
    for batch in batches:
        blocks, numbers, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        ends = np.cumsum(np.array([len(t) for t in texts.to_pylist()], np.int64))
        at = 0
        while at < len(ends):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHARACTERS, "right")))
            if ends[end - 1] > (ends[at - 1] if at else 0):
                yield _lists(blocks[at:end], numbers[at:end], texts.slice(at, end - at).to_pylist())
            at = end


class TextIndex:
    """An index at a path; made once, then searched."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, pages: DataFrame, path: str, *, pages_per_block: int = 10_000) -> TextIndex:
        """pages: doc_id, page_num, text and what else is to be given back. Pages without text are kept, and found by no trigram."""
        index = cls(pages.sparkSession, path)
        blocks = max(1, math.ceil(pages.count() / pages_per_block))
        placed = pages.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")).withColumn("shelf", F.pmod("block", F.lit(SHELVES)).cast("int"))
        own = Window.partitionBy("shelf", "block").orderBy("doc_id", "page_num")
        numbered = placed.repartition("shelf").withColumn("number", F.row_number().over(own))
        numbered.write.partitionBy("shelf").parquet(f"{index.path}/pages")
        held = index.pages().select("block", "number", F.encode(fold(F.coalesce("text", F.lit(""))), "UTF-8").alias("text"))
        lists = held.mapInArrow(_listed, _LISTS).withColumn("bucket", _bucket(F.col("gram")))
        # a common trigram has an entry for each block: its bucket is dealt to several tasks
        dealt = lists.repartition("bucket", F.pmod("block", F.lit(8))).sortWithinPartitions("bucket", "gram", "block")
        dealt.write.partitionBy("bucket").parquet(f"{index.path}/grams")
        counts = index._grams().groupBy("bucket", "gram").agg(F.sum("pages").alias("pages"))
        counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{index.path}/counts")
        return index

    def pages(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/pages")

    def _grams(self) -> DataFrame:
        return self.spark.read.schema(f"{_LISTS}, bucket int").parquet(f"{self.path}/grams")

    def _of(self, table: DataFrame, grams: list[str]) -> DataFrame:
        """Rows of some trigrams, from their buckets: the buckets are constants of the plan."""
        wanted = F.lit(False)
        for g in grams:
            wanted = wanted | ((F.col("bucket") == _bucket(F.lit(g))) & (F.col("gram") == g))
        return table.filter(wanted)

    def candidates(self, words: str) -> DataFrame | None:
        """block and number of the pages that hold the rarest trigrams of the words; None if there are no trigrams."""
        folded = self.spark.range(1).select(fold(F.lit(words)).alias("f")).first()["f"]
        asked = sorted({folded[k : k + 3] for k in range(len(folded) - 2)})
        if not asked:
            return None
        counts = self.spark.read.schema("gram string, pages long, bucket int").parquet(f"{self.path}/counts")
        found = {r["gram"]: r["pages"] for r in self._of(counts, asked).select("gram", "pages").collect()}  # a row for each trigram asked for
        rarest = sorted(asked, key=lambda g: (found.get(g, 0), g))[:RAREST]
        if found.get(rarest[0], 0) == 0:
            return self.spark.createDataFrame([], "block int, number int")
        sums = F.aggregate("steps", F.array().cast("array<int>"), lambda done, s: F.concat(done, F.array(s + F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)))))
        listed = self._of(self._grams(), rarest).select("block", F.explode(sums).alias("number"))
        return listed.groupBy("block", "number").agg(F.count("*").alias("n")).filter(F.col("n") == len(rarest)).select("block", "number")

    def pages_with(self, words: str) -> DataFrame:
        """Pages that may hold the words, case aside: all that do, and few others."""
        near = self.candidates(words)
        if near is None:
            return self.pages().drop("block", "number", "shelf")
        near = staged(near, "candidates")
        blocks = [r["block"] for r in near.select("block").distinct().limit(NAMED_BLOCKS + 1).collect()]
        pages = self.pages()
        if not blocks:
            return self.spark.createDataFrame([], pages.schema).drop("block", "number", "shelf")
        if len(blocks) <= NAMED_BLOCKS:
            shelves = sorted({b % SHELVES for b in blocks})
            pages = self.spark.read.schema(pages.schema).option("basePath", f"{self.path}/pages").parquet(*(f"{self.path}/pages/shelf={n}" for n in shelves)).filter(F.col("block").isin(blocks))
        return pages.join(near, ["block", "number"], "left_semi").drop("block", "number", "shelf")

    def search(self, words: str, case_sensitive: bool = False) -> DataFrame:
        """keyword_search() over the pages that may hold the words."""
        return keyword_search(self.pages_with(words), words, case_sensitive)
