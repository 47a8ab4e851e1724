"""Filter interaction audit: what each of several filters removes in every order of applying them.

Whether a document fails a filter does not depend on the other filters, so one mask of failures for each document
says what any order would do: before filter f, after the filters of a set S, those documents are left whose mask
meets no filter of S. A part of the corpus therefore needs one counter for each set of filters, and these add up
over tasks: they are summed before they are shuffled, and all orders are read off them afterwards.

Repeated texts are found by sorting, not by grouping, so that a text that a third of all rows share is spread like
any other: rows are dealt by ranges of (fingerprint, doc_id) and sorted in each range by (fingerprint, full text,
doc_id); a row repeats an earlier one if its text is its predecessor's and the first row of that run has a smaller
id. Runs that a range boundary may have cut, those with the fingerprint of a range's first or last row, are summed up
in a line each, and the first id of the whole run, taken over ranges, is given back to the range it goes on in.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import lean
from .scratch import materialise, only_result
from .words import text_batches

#: One letter for each filter, in the order of their bits.
FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")


def _words(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " ", -1), "")


def failures(text: Column) -> Column:
    """Bits of the filters that a text fails by itself: too few words, too repetitive, too many capitals, symbols."""
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    symbols = F.length(text) > F.length(F.translate(text, "#$%&*|", ""))

    def mask(w: Column) -> Column:
        n, distinct = F.size(w), F.size(F.array_distinct(w))
        failed = (n < 50, 100 * distinct.cast("long") < 65 * n.cast("long"), 100 * capitals.cast("long") > 5 * F.length(text).cast("long"), symbols)
        return sum((F.when(c, 1 << bit).otherwise(0) for bit, c in enumerate(failed)), F.lit(0)).cast("int")

    # words once, for both conditions on them
    return F.transform(F.array(_words(text)), mask)[0]


# --- repeated texts ----------------------------------------------------------------------------------------------


def _runs(schema: pa.Schema):
    """Rows of one range in order of (mark, text, doc_id) -> part, doc_id, mask, repeated, key, first.

    Rows with the range's first mark may go on a run of an earlier range: their key is their text's digest. A row
    without a mask follows for each run with the first or the last mark: its key, and the first doc_id it has here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = mark = None
        here: list[tuple[bytes, object, str | None]] = []  # the runs that have this mark: text, first id, key
        edges: dict[str, object] = {}
        for batch in batches:
            for lo, texts in text_batches(batch, limit=1 << 22):
                rows = batch.slice(lo, len(texts))
                ids, firsts, keys = rows["doc_id"].to_pylist(), [], []
                for text, own, i in zip(texts, rows["mark"].to_pylist(), ids, strict=True):
                    if own != mark:
                        head, mark, here = own if head is None else head, own, []
                    if not here or here[-1][0] != text:
                        here.append((text, i, _key(text) if own == head else None))
                        if own == head:
                            edges[here[-1][2]] = i
                    firsts.append(here[-1][1])
                    keys.append(here[-1][2])
                repeated = [i is not None and first is not None and first < i for i, first in zip(ids, firsts, strict=True)]
                none = pa.nulls(len(ids), schema.field("doc_id").type)
                yield pa.RecordBatch.from_arrays([rows["part"].cast(pa.string()), rows["doc_id"].cast(schema.field("doc_id").type), rows["mask"], pa.array(repeated), pa.array(keys, pa.string()), none], schema=schema)
        edges |= {_key(text): first for text, first, _ in here}
        if edges:
            yield pa.RecordBatch.from_pylist([{"key": key, "first": first} for key, first in edges.items()], schema)

    return run


def _key(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def failure_masks(docs: DataFrame) -> DataFrame:
    """part, doc_id and mask of every row of docs (doc_id, source, text): a bit for each filter that it fails.

    A text is repeated if a row with the same text has a smaller doc_id. A null text is an empty one, a null source
    an empty part. Rows without a doc_id repeat nothing and are repeated by nothing; rows of one doc_id do
    not repeat each other.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "doc_id", text.alias("text"), F.xxhash64(text).alias("mark"))
    last = F.col("doc_id").asc_nulls_last()
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "mark", last)
    # masks after the exchange: its ranges come from a sample, which reads what stands before it once more
    dealt = dealt.sortWithinPartitions("mark", "text", last).withColumn("mask", failures(F.col("text")))
    of = kind.simpleString()
    arrow = to_arrow_type(kind)
    schema = pa.schema([("part", pa.string()), ("doc_id", arrow), ("mask", pa.int32()), ("repeated", pa.bool_()), ("key", pa.string()), ("first", arrow)])
    found = dealt.mapInArrow(lean(_runs(schema)), f"part string, doc_id {of}, mask int, repeated boolean, key string, first {of}")
    found = materialise(found, "masks")
    # at most a few rows for each range
    begun = found.filter("mask is null").groupBy("key").agg(F.min("first").alias("begun"))
    rows = found.filter("mask is not null").drop("first").join(F.broadcast(begun), "key", "left")
    repeated = F.col("repeated") | F.coalesce(F.col("begun") < F.col("doc_id"), F.lit(False))
    return rows.select("part", "doc_id", F.col("mask").bitwiseOR(F.when(repeated, REPEATED).otherwise(0)).alias("mask"))


# --- counters ----------------------------------------------------------------------------------------------------


def count_masks(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask and how many documents have both: n, good (a label of quality 1), toxic (a label of toxic 1)."""
    marked = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    joined = masks.join(marked, "doc_id", "left")
    return joined.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")))


def audit_orders(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """counts (part, mask, n, good, toxic) -> a row for each part, order of the filters and step.

    ``left[S]`` holds the documents that pass all filters of the set S, a bit mask; everything asked for is a sum or
    difference of these counters.
    """
    k = len(filters)
    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("had"))  # at most 2 ** k entries

    def left(field: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit((1 << k) - 1)), lambda s: F.aggregate(F.filter("had", lambda h: h["mask"].bitwiseAND(s) == 0), F.lit(0).cast("long"), lambda a, h: a + h[field]))

    only = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda b: F.aggregate(F.filter("had", lambda h: h["mask"] == F.pow(F.lit(2), b).cast("int")), F.lit(0).cast("long"), lambda a, h: a + h["n"]))
    counters = by_part.select("part", *(left(c).alias(f"left_{c}") for c in ("n", "good", "toxic")), only.alias("only"))

    def shapley(bit: int) -> Column:
        """Documents removed by a filter, over all orders: each set of others stands before it in |S|! (k - 1 - |S|)! orders."""
        sets = [s for s in range(1 << k) if not s >> bit & 1]
        ways = {s: math.factorial(s.bit_count()) * math.factorial(k - 1 - s.bit_count()) for s in sets}
        return sum((F.lit(ways[s]) * (F.col("left_n")[s] - F.col("left_n")[s | 1 << bit]) for s in sets), F.lit(0).cast("long"))

    counters = counters.withColumn("over_orders", F.array(*map(shapley, range(k))))
    orders = F.lit(["".join(p) for p in itertools.permutations(filters)])
    steps = counters.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    bit = F.instr(F.lit(filters), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    earlier = F.aggregate(F.slice(F.split("filter_order", ""), 1, F.col("step") - 1), F.lit(0), lambda a, f: a + F.pow(F.lit(2), F.instr(F.lit(filters), f) - 1).cast("int"))
    steps = steps.withColumn("bit", bit).withColumn("before", earlier).withColumn("own", F.pow(F.lit(2), F.col("bit")).cast("int")).withColumn("after", F.col("before") + F.col("own"))

    def gone(field: str) -> Column:
        return F.col(f"left_{field}")[F.col("before")] - F.col(f"left_{field}")[F.col("after")]

    failing = F.col("left_n")[0] - F.col("left_n")[F.col("own")]
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), F.col("left_n")[F.col("after")].alias("kept"), gone("n").alias("removed"), (failing - gone("n")).alias("redundant"),
        F.col("only")[F.col("bit")].alias("unique_fails"), gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), F.col("over_orders")[F.col("bit")].alias("shapley"),
    )


@only_result
def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley for every
    part of docs (doc_id, source, text) and every order of the five filters; labels (doc_id, quality, toxic).

    Other columns are ignored. Odd rows are judged as ``failure_masks`` says; a document with several labels has what
    any of them says, one without counts as neither good nor toxic. Without documents there are no parts and no rows.
    """
    return audit_orders(count_masks(failure_masks(docs), labels))
