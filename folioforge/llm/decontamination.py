"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item's windows of ``window`` consecutive words are sets of word shingles. A document contains a
window when it holds all of them in place, so a window's necessary prefix is one shingle; the rarest over the
corpus is taken, which keeps frequent passages from producing candidates. Shingles of documents meet these
prefix tokens by hash; the token's place in the window says where the window would have to start (positional
filter), and whether it would fit the text (length filter); the window's words are then compared exactly.

The benchmark's index is broadcast in slices of bounded size. With more slices than one, documents pass
through one map after another, so any benchmark size works and documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .memory import lean
from .words import ALNUM, Words, sequence_hash, shingles, split_words, text_batches

#: Words in a shingle.
SHINGLE = 5
#: Bytes of benchmark text whose index is broadcast at once.
SLICE_BYTES = 8 << 20
_BITS = 22


@dataclass
class Lookup:
    """Sorted 64-bit keys with a bitmap in front."""

    keys: np.ndarray

    def __post_init__(self) -> None:
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in hashes, places in keys) of hashes that are keys."""
        maybe = np.flatnonzero(self.bitmap[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
        at = np.searchsorted(self.keys, hashes[maybe])
        hit = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == hashes[maybe]) if len(self.keys) else np.zeros(len(maybe), bool)
        return maybe[hit], at[hit]


@dataclass
class Windows:
    """The distinct windows of one length: their words' hashes, items that hold them, prefix token and its offset."""

    size: int
    words: np.ndarray
    items: list[list[str]]
    token: np.ndarray
    offset: np.ndarray


def item_windows(items: list[tuple[str, bytes]], window: int) -> dict[int, dict[bytes, list[str]]]:
    """By length: the windows (bytes of their word hashes) and the items that hold each."""
    found: dict[int, dict[bytes, list[str]]] = {}
    words = split_words([t for _, t in items], ALNUM)
    bounds = words.bounds()
    for k, (name, _) in enumerate(items):
        own = words.hash[bounds[k] : bounds[k + 1]]
        if size := min(window, len(own)):
            for at in range(len(own) - size + 1):
                held = found.setdefault(size, {}).setdefault(own[at : at + size].tobytes(), [])
                if name not in held[-1:]:
                    held.append(name)
    return found


def _grams(row: np.ndarray) -> list[int]:
    k = min(SHINGLE, len(row))
    return [sequence_hash(row[i : i + k]) for i in range(len(row) - k + 1)]


def build_index(found: dict[int, dict[bytes, list[str]]], counts: dict[int, int]) -> list[Windows]:
    """The windows with their rarest shingle as prefix token; counts: shingles in the corpus (absent: 0)."""
    out = []
    for size, held in sorted(found.items()):
        rows = [np.frombuffer(b, np.uint64) for b in held]
        token, offset = [], []
        for row in rows:
            grams = _grams(row)
            best = min(range(len(grams)), key=lambda i: (counts.get(grams[i], 0), grams[i]))
            token.append(grams[best])
            offset.append(best)
        order = np.argsort(np.array(token, np.uint64), kind="stable")
        names = list(held.values())
        out.append(Windows(size, np.array(rows, np.uint64)[order], [names[i] for i in order], np.array(token, np.uint64)[order], np.array(offset, np.int64)[order]))
    return out


def _count(grams: np.ndarray, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, total = Lookup(grams), np.zeros(len(grams), np.int64)
        for batch in batches:
            for _, texts in text_batches(batch):
                words = split_words(texts, ALNUM)
                for k in sizes:
                    total += np.bincount(lookup.find(shingles(words, k)[1])[1], minlength=len(grams))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(grams[some].view(np.int64)), pa.array(total[some])], ["gram", "n"])

    return run


def occurrences(words: Words, index: list[Windows], lookups: list[Lookup]) -> Iterator[tuple[np.ndarray, int, list[list[str]], np.ndarray]]:
    """For each length of windows: (first words of occurrences, length, items of windows, which window)."""
    for own, lookup in zip(index, lookups, strict=True):
        first, hashes = shingles(words, min(SHINGLE, own.size))
        place, key = lookup.find(hashes)
        lo = np.searchsorted(own.token, lookup.keys[key])
        sizes = np.searchsorted(own.token, lookup.keys[key], "right") - lo
        ends = np.cumsum(sizes)
        which = np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - sizes), sizes)
        at = first[np.repeat(place, sizes)]
        doc = words.doc[at]
        start = at - own.offset[which]
        fits = (start >= 0) & (start + own.size <= len(words.hash))
        start, which, doc = start[fits], which[fits], doc[fits]
        fits = (words.doc[start] == doc) & (words.doc[start + own.size - 1] == doc)
        start, which = start[fits], which[fits]
        same = np.ones(len(start), bool)
        for j in range(own.size):
            same &= words.hash[start + j] == own.words[which, j]
        yield start[same], own.size, own.items, which[same]


_HIT_TYPE = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_MARKS, _ITEMS = "__marks", "__items"


def _mark(index: list[Windows], carried: int, last: bool):
    """carried: columns before the two of the state, which are passed on as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = [Lookup(np.unique(w.token)) for w in index]
        for batch in batches:
            names = batch.schema.names[:carried]
            for lo, texts in text_batches(batch):
                words = split_words(texts, ALNUM)
                bounds, n = words.bounds(), len(texts)
                edge = np.zeros(len(words.hash) + 1, np.int64)
                held: dict[int, set[str]] = {}
                for start, size, found, which in occurrences(words, index, lookups):
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + size, -1)
                    for k, w in set(zip(words.doc[start].tolist(), which.tolist(), strict=True)):
                        held.setdefault(k, set()).update(found[w])
                hit = np.cumsum(edge[:-1]) > 0
                part = batch.slice(lo, n)
                before, names_before = (part.column(carried + i).to_pylist() for i in (0, 1))
                for k in (i for i in range(n) if before[i] is not None):
                    hit[bounds[k] : bounds[k + 1]] |= np.unpackbits(np.frombuffer(before[k], np.uint8), count=bounds[k + 1] - bounds[k]).astype(bool)
                    held.setdefault(k, set()).update(names_before[k])
                items = [sorted(held.get(k, ())) for k in range(n)]
                own = [hit[bounds[k] : bounds[k + 1]] for k in range(n)]
                kept, listed = part.columns[:carried], pa.array(items, pa.list_(pa.string()))
                if not last:
                    marks = [np.packbits(x).tobytes() if items[k] else None for k, x in enumerate(own)]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(marks, pa.binary()), listed], [*names, _MARKS, _ITEMS])
                    continue
                spans = []
                for k, x in enumerate(own):
                    step = np.flatnonzero(np.diff(np.concatenate(([0], x.view(np.int8), [0])))) if items[k] else np.empty(0, np.int64)
                    spans.append([{"first": a, "last": b - 1} for a, b in step.reshape(-1, 2).tolist()])
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(np.diff(bounds)), pa.array([int(x.sum()) for x in own], pa.int64()), listed, pa.array(spans, _HIT_TYPE)],
                    [*names, "n_words", "n_hit", "items", "hits"],
                )

    return run


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, slice_bytes: int = SLICE_BYTES, record: bool = False) -> DataFrame:
    """Find the words of documents that stand inside an occurrence of a benchmark window.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. A window is ``window`` consecutive
    words of an item; an item of fewer, but not none, is one window. Returns for each row of docs: doc_id (with
    record: ``record``, a struct of all its columns), n_words, n_hit, items (ids as strings, sorted, of items with
    occurring windows) and hits (ranges of hit words, first to last, from 0).

    Null and empty texts have no words. Repeated items count once for their id, null item ids are left out;
    repeated documents are rows of their own. An empty benchmark hits nothing. A window that many items share
    lists at most the items of one slice.
    """
    inner = docs if record else docs.select("doc_id", "text")
    names, fields = inner.columns, list(inner.schema)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("body")).filter("item is not null and body is not null").distinct()
    size = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    slices = max(1, -(-size // slice_bytes))
    carried = [f"__{i}" if n != "text" else n for i, n in enumerate(names)]  # apart from the names added
    state = inner.toDF(*carried).withColumns({_MARKS: F.lit(None).cast("binary"), _ITEMS: F.array().cast("array<string>")})
    fields = [StructField(n, f.dataType) for n, f in zip(carried, fields, strict=True)]
    listed = ArrayType(StringType())
    for k in range(slices):
        own = items.filter(F.pmod(F.xxhash64("item", "body"), F.lit(slices)) == k).collect()  # about slice_bytes
        found = item_windows(sorted((r["item"], r["body"].encode()) for r in own), window)
        rows = [np.frombuffer(b, np.uint64) for held in found.values() for b in held]
        grams = np.unique(np.array([g for row in rows for g in _grams(row)], np.uint64))
        sizes = sorted({min(SHINGLE, n) for n in found})
        counted = docs.select("text").mapInArrow(lean(_count(grams, sizes)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect() if sizes else []
        index = build_index(found, {r["gram"] & (2**64 - 1): r["n"] for r in counted})
        last = k == slices - 1
        more = [StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("items", listed), StructField("hits", ArrayType(StructType([StructField("first", LongType()), StructField("last", LongType())])))] if last else [StructField(_MARKS, BinaryType()), StructField(_ITEMS, listed)]
        state = state.mapInArrow(lean(_mark(index, len(carried), last)), StructType([*fields, *more]))
    results = ("n_words", "n_hit", "items", "hits")
    if record:
        return state.select(F.struct(*(F.col(c).alias(n) for c, n in zip(carried, names, strict=True))).alias("record"), *results)
    return state.select(F.col(carried[0]).alias("doc_id"), *results)
