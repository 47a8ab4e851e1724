"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, word pairs, triples and pairs with one or two words
between. Each coordinate has its own learning rate; L1 keeps most weights at zero, so the model is a short list
of (index, weight), which is what gets broadcast. Scoring is one map over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .memory import lean
from .scratch import materialise, smallest
from .words import ALNUM, PLACES, Words, mix, split_words, text_batches

#: Labelled rows that training takes at most: those with the smallest hash of their id.
TRAIN_ROWS = 20_000
#: Bits of a feature's index.
BITS = 20
#: (kind, distances between the words taken)
GRAMS = ((1, (0,)), (2, (0, 1)), (3, (0, 1, 2)), (4, (0, 2)), (5, (0, 3)))


@dataclass(frozen=True)
class Ftrl:
    """alpha, beta: learning rate; l1, l2: penalties; epochs over the sample; prior: score without any label.

    A feature has to be in ``examples`` examples: what is in one or two can only be learned by heart.
    """

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 0.01
    epochs: int = 3
    examples: int = 5
    prior: float = 0.05


def features(words: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature index) of every n-gram and skip-gram; index 0 is never given: it is the intercept's."""
    docs, found = [], []
    top = np.uint64(2**bits - 1)
    for kind, places in GRAMS:
        n = len(words.hash) - places[-1]
        if n <= 0:
            continue
        total = np.full(n, PLACES[40 + kind])
        for p in places:
            total += words.hash[p : n + p] * PLACES[p + 8 * kind]
        same = words.doc[:n] == words.doc[places[-1] :]
        docs.append(words.doc[:n][same])
        found.append(np.maximum(mix(total[same]) & top, np.uint64(1)).astype(np.int64))
    if not docs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(docs), np.concatenate(found)


def _pack(index: np.ndarray, bits: int) -> bytes:
    """Sorted distinct indices as bytes: how many there are for each value of the high bits, then the low 16 bits."""
    return np.bincount(index >> 16, minlength=1 << max(0, bits - 16)).astype("<u4").tobytes() + (index & 0xFFFF).astype("<u2").tobytes()


def _unpack(packed: np.ndarray, bits: int) -> np.ndarray:
    """The indices that _pack() was given; packed: its bytes as 16-bit numbers."""
    high = 1 << max(0, bits - 16)
    return np.repeat(np.arange(high, dtype=np.int64) << 16, packed[: 2 * high].view("<u4")) + packed[2 * high :]


def _extract(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in text_batches(batch):
                doc, index = features(split_words(texts, ALNUM), bits)
                pairs = np.unique((doc << 32) | index)
                cuts = np.searchsorted(pairs >> 32, np.arange(len(texts) + 1))
                rows = [_pack(pairs[cuts[k] : cuts[k + 1]] & 0xFFFFFFFF, bits) for k in range(len(texts))]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, len(texts)), batch.column(2).slice(lo, len(texts)), pa.array(rows, pa.binary())], ["place", "label", "indices"])

    return run


def _weights(z: np.ndarray, n: np.ndarray, how: Ftrl) -> np.ndarray:
    """The closed form of a weight from its two sums: zero within the L1 bound."""
    return np.where(np.abs(z) > how.l1, (np.sign(z) * how.l1 - z) / ((how.beta + np.sqrt(n)) / how.alpha + how.l2), 0.0)


def fit_ftrl(labels: list[int], examples: list[np.ndarray], how: Ftrl, bits: int) -> dict[int, float]:
    """Labels and packed indices of the examples -> non-zero weights. Index 0 is the intercept: a coordinate
    like the others, in every example, but without the L1 bound; it starts at the labels' smoothed share.
    """
    rate = (sum(labels) + how.prior * 20) / (len(labels) + 20)
    often = np.zeros(2**bits, np.int32)
    for packed in examples:
        often[_unpack(packed, bits)] += 1
    often = often >= how.examples
    z, n = np.zeros(2**bits), np.zeros(2**bits)
    z0, n0 = -float(np.log(rate / (1 - rate))) * (how.beta / how.alpha + how.l2), 0.0
    for _ in range(how.epochs):
        for y, packed in zip(labels, examples, strict=True):
            at = _unpack(packed, bits)
            at = at[often[at]]
            za, na = z[at], n[at]
            w = _weights(za, na, how)
            w0 = -z0 / ((how.beta + n0**0.5) / how.alpha + how.l2)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + w0, -35, 35))) - y
            z[at] = za + g - (np.sqrt(na + g * g) - np.sqrt(na)) / how.alpha * w
            n[at] = na + g * g
            z0 += g - ((n0 + g * g) ** 0.5 - n0**0.5) / how.alpha * w0
            n0 += g * g
    live = np.flatnonzero(np.abs(z) > how.l1)
    bias = -z0 / ((how.beta + n0**0.5) / how.alpha + how.l2)
    return {0: float(bias)} | dict(zip(live.tolist(), _weights(z[live], n[live], how).tolist(), strict=True))


def _fit(how: Ftrl, bits: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels: list[int] = []
        examples: list[np.ndarray] = []
        for batch in batches:  # in order of place
            taken = batch.slice(0, max(0, rows - len(labels)))
            labels += taken.column(1).to_pylist()
            # copies, so that a batch can go as soon as it is read
            examples += [np.frombuffer(v.as_buffer(), "<u2").copy() for v in taken.column(2)]
        if labels:
            model = fit_ftrl(labels, examples, how, bits)
            yield pa.RecordBatch.from_arrays([pa.array(list(model), pa.int64()), pa.array(list(model.values()), pa.float64())], ["index", "weight"])

    return run


def train_toxicity(docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS, how: Ftrl = Ftrl(), bits: int = BITS) -> dict[int, float]:
    """Weights learned from at most ``rows`` labelled documents.

    labels: doc_id and toxic (0 or 1; other and null values are left out), already restricted to what may be
    learned from. The sample is the rows with the smallest hash of doc_id, whatever their label; with repeated
    ids, among documents or labels, the first ``rows`` pairs in that order. One task fits it: its size is
    bounded by ``rows``, and an example is two bytes a feature. Without a usable label every score is ``prior``.
    """
    chosen = labels.filter("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("label"), F.xxhash64("doc_id").alias("place"))
    chosen = smallest(chosen, "place", rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "place", "label")
    held = materialise(sample.mapInArrow(lean(_extract(bits)), "place long, label int, indices binary"), "examples")
    fitted = held.repartition(1).sortWithinPartitions("place", "label", "indices").mapInArrow(lean(_fit(how, bits, rows)), "index long, weight double")
    found = {r["index"]: r["weight"] for r in fitted.collect()}  # at most 2**bits
    return found or {0: float(np.log(how.prior / (1 - how.prior)))}


def _score(model: dict[int, float], bits: int, name: str):
    weights = np.array(sorted(model.items()), np.float64).reshape(-1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(2**bits)
        table[weights[:, 0].astype(np.int64)] = weights[:, 1]
        bias, table[0] = table[0], 0
        live = table != 0
        for batch in batches:
            for lo, texts in text_batches(batch):
                doc, index = features(split_words(texts, ALNUM), bits)
                kept = live[index]
                pairs = np.unique((doc[kept] << 32) | index[kept])
                total = bias + np.bincount(pairs >> 32, table[pairs & 0xFFFFFFFF], len(texts))
                yield batch.slice(lo, len(texts)).append_column(name, pa.array(1 / (1 + np.exp(-np.clip(total, -500, 500)))))

    return run


def add_toxicity(docs: DataFrame, model: dict[int, float], name: str = "score", *, bits: int = BITS) -> DataFrame:
    """docs, rows and columns as they are, with the toxicity score (0 to 1) of ``text`` in a further column."""
    return docs.mapInArrow(lean(_score(model, bits, name)), StructType([*docs.schema, StructField(name, DoubleType())]))


def score_toxicity(docs: DataFrame, model: dict[int, float], *, bits: int = BITS) -> DataFrame:
    """doc_id and score (0 to 1) of every row of docs: doc_id and text, other columns ignored.

    Null and empty texts get the intercept's score, repeated rows the same score. Whole texts are scored.
    """
    return add_toxicity(docs.select("doc_id", "text"), model, bits=bits).select("doc_id", "score")
