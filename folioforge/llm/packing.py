"""Best-fit packing by exact-complement hashing.

Documents become token pieces of at most ``capacity`` tokens. How pieces share sequences depends on their
lengths only, so the plan is made from a histogram of at most ``capacity`` lengths: sums of one, two and three
available lengths are indexed, and for each length from the longest down, combinations that fill its gap
exactly are consumed, each as often as availability counts allow; what is left goes best-fit into the
tightest gap. Every step uses up one length, so the plan has a few thousand lines whatever the corpus holds.
Pieces then find their place by their rank among pieces of their length, and ranks come from counts of each
input part: nothing but the histogram reaches the driver, and no task sees all pieces of a length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .memory import lean
from .scratch import materialise
from .tokens import encoder
from .words import text_batches

CAPACITY = 2048


def _combination(gap: int, have: np.ndarray, own: int) -> Counter | None:
    """One, two or three available lengths that sum to gap; own has already been taken once."""
    left = have.copy()
    left[own] -= 1
    if gap < len(left) and left[gap] > 0:
        return Counter({gap: 1})
    some = (left > 0).astype(np.int64)
    if (pair := _pair(gap, left, some)) is not None:
        return pair
    sums = np.convolve(some, some)
    thirds = np.flatnonzero(some[: gap + 1])
    for c in thirds[sums[gap - thirds] > 0][::-1].tolist():
        left[c] -= 1
        some[c] = left[c] > 0
        pair = _pair(gap - c, left, some)
        left[c] += 1
        some[c] = 1
        if pair is not None:
            return pair + Counter({c: 1})
    return None


def _pair(gap: int, left: np.ndarray, some: np.ndarray) -> Counter | None:
    half = some[: gap + 1] & some[: gap + 1][::-1]
    for a in np.flatnonzero(half)[::-1].tolist():
        if a * 2 < gap:
            break
        if a * 2 != gap:
            return Counter({a: 1, gap - a: 1})
        if left[a] >= 2:
            return Counter({a: 2})
    return None


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how many sequences, [(length, copies in each)]) lines that hold every counted piece once."""
    have = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        have[length] += count
    plan: list[tuple[int, list[tuple[int, int]]]] = []
    for length in range(capacity, 0, -1):
        while have[length]:
            rest = _combination(capacity - length, have, length) if length < capacity else Counter()
            if rest is None:
                break
            line = rest + Counter({length: 1})
            times = int(min(have[x] // k for x, k in line.items()))
            for x, k in line.items():
                have[x] -= k * times
            plan.append((times, sorted(line.items(), reverse=True)))
    open_gaps: list[list] = []  # [gap, sequences, their pieces]
    for length in range(capacity, 0, -1):
        count = int(have[length])
        while count:
            fits = [g for g in open_gaps if g[0] >= length]
            if not fits:
                break
            best = min(fits, key=lambda g: g[0])
            times = min(count, best[1])
            best[1] -= times
            if not best[1]:
                open_gaps.remove(best)
            open_gaps.append([best[0] - length, times, best[2] + Counter({length: 1})])
            count -= times
        for copies, times in ((capacity // length, count // (capacity // length)), (count % (capacity // length), 1)):
            if copies and times:
                open_gaps.append([capacity - copies * length, times, Counter({length: copies})])
    return plan + [(times, sorted(pieces.items(), reverse=True)) for _, times, pieces in open_gaps]


def _places(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """For each length and range of ranks: first sequence, copies in a sequence, offset of the first."""
    rows, taken, sequence = [], Counter(), 0
    for times, line in plan:
        offset = 0
        for length, copies in line:
            rows.append((length, taken[length], sequence, copies, offset))
            taken[length] += copies * times
            offset += copies * length
        sequence += times
    rows.sort()
    names = ("length", "rank", "sequence", "copies", "offset")
    return dict(zip(names, np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def _tokenise(path: str, id_type: pa.DataType, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        own_encoder, seen = encoder(path), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for lo, texts in text_batches(batch):
                flat, bounds = own_encoder.encode(texts)
                row, piece, start, length, rank, ids = [], [], [], [], [], []
                for k in range(len(texts)):
                    own = np.append(flat[bounds[k] : bounds[k + 1]], np.uint32(end_id)).astype("<u4")
                    for j, at in enumerate(range(0, len(own), capacity)):
                        cut = own[at : at + capacity]
                        row.append(lo + k)
                        piece.append(j)
                        start.append(at)
                        length.append(n := len(cut))
                        rank.append(seen[n])
                        seen[n] += 1
                        ids.append(cut.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row, pa.int64())).cast(id_type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                        pa.array(ids, pa.binary()), pa.array([part] * len(row), pa.int32()), pa.array(rank, pa.int64()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids", "part", "rank"],
                )

    return run


def _assign(places: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (places["length"] << 45) + places["rank"]
        for batch in batches:
            names = batch.schema.names
            length, rank = (batch.column(names.index(x)).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            at = np.searchsorted(key, (length << 45) + rank, "right") - 1
            ahead, copies = rank - places["rank"][at], places["copies"][at]
            sequence = places["sequence"][at] + ahead // copies
            offset = places["offset"][at] + ahead % copies * length
            kept = [i for i, x in enumerate(names) if x != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(sequence), pa.array(offset)], [*(names[i] for i in kept), "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, end_id: int = 0, payload: dict[str, Column] | None = None) -> DataFrame:
    """Pack every document's tokens into as few sequences of ``capacity`` as the method finds.

    docs: doc_id and text; other columns are ignored. A document is its text's token ids and then ``end_id``;
    a null or empty text is ``end_id`` alone. Documents over ``capacity`` are cut into full pieces and a rest.
    Returns one row for each piece: doc_id, piece, start, length, the payload, sequence_id, offset. The payload
    defaults to ``ids`` (little-endian 32-bit ids, binary); expressions over ``ids`` given instead are
    evaluated as pieces are made, so only their values travel on.

    Repeated rows and null ids are documents like any other. An empty table gives an empty result.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    payload = {"ids": F.col("ids")} if payload is None else payload
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids binary, part int, rank long"
    pieces = docs.mapInArrow(lean(_tokenise(tokenizer_path, to_arrow_type(kind), capacity, end_id)), schema)
    pieces = materialise(pieces.select("doc_id", "piece", "start", "length", *(c.alias(n) for n, c in payload.items()), "part", "rank"), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "part"]).select("doc_id", "piece", "start", "length", *payload, (F.col("base") + F.col("rank")).alias("rank"))
    out = StructType([f for f in ranked.schema if f.name != "rank"] + [StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(_assign(_places(plan_sequences(histogram, capacity))), out)
