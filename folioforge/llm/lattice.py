"""Language-model scores from a subword lattice.

A word (with its leading mark) can be cut into pieces of an existing vocabulary in many ways. Each piece has a
probability. The vocabulary's own scores (merge ranks) give the starting ones and a prior; then a few rounds of
expectation and maximisation over the training words count each piece as often as it is expected over all
segmentations of every word (forward and backward recursion in log space). The probability of a word is the sum
over all its segmentations; that of a text the product over its words and the end mark. Beside it goes a plain
unigram score of words.

Words of one length are treated together, as arrays: pieces are found by walking all words through a trie of the
vocabulary at once, and each piece found is an edge of many lattices.

Corpus counts without shuffling texts word by word: each input task numbers the distinct words of blocks of
documents, so a text becomes an array of small numbers and a block a list of words with counts. Only those
lists are counted over the corpus; each distinct word is scored once, and its score joined to the blocks that hold
it, whose scores then meet their documents again. The joins are sort-merge joins that adaptive execution splits
when a word is in very many blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .memory import lean
from .scratch import drop_spent_shuffles, materialise, only_result
from .words import SPACED, split_words, text_batches

#: A block ends with the batch that brings it to so many words or distinct words.
BLOCK_WORDS, BLOCK_DISTINCT = 8_000_000, 500_000
#: Pseudo-count shared by all pieces according to the vocabulary's ranks.
PRIOR = 2_000.0
#: Rounds of expectation and maximisation.
ROUNDS = 3
#: Words that are treated as arrays together, and the length from which a word is treated by itself.
TOGETHER, LONG = 8192, 64
MARK = "▁"


@dataclass
class Pieces:
    """Natural-log probabilities: pieces by their text, single bytes, and the end of a text."""

    log: dict[str, float]
    byte: list[float]
    end: float
    longest: int

    def word(self, text: str) -> float:
        """log10 of the sum over all segmentations of the marked word."""
        s = MARK + text
        log, get, n, longest = self.log, self.log.get, len(s), self.longest
        alpha = [0.0] * (n + 1)
        for j in range(1, n + 1):
            terms = []
            for i in range(j - longest if j > longest else 0, j):
                p = get(s[i:j])
                if p is not None:
                    terms.append(alpha[i] + p)
            if s[j - 1] not in log:
                terms.append(alpha[j - 1] + sum(self.byte[b] for b in s[j - 1].encode()))
            top = max(terms)
            alpha[j] = top + math.log(sum(math.exp(t - top) for t in terms)) if len(terms) > 1 else top
        return alpha[n] / math.log(10)


@dataclass
class Vocabulary:
    """The usable pieces of a model file: text (bytes: None), byte value, share that the ranks give; and a trie."""

    text: list[str | None]
    byte: np.ndarray
    weight: np.ndarray

    def __post_init__(self) -> None:
        known: dict[tuple[int, int], int] = {}
        accept = [-1]
        for k, piece in enumerate(self.text):
            state = 0
            for c in piece or "":
                following = known.setdefault((state, ord(c)), len(accept))
                if following == len(accept):
                    accept.append(-1)
                state = following
            if piece:
                accept[state] = k
        self.accept = np.array(accept, np.int64)
        bits = max(10, 2 + len(accept).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        keys = np.array([(s << 21) | c for s, c in known], np.uint64)
        self.keys, self.next = np.full(1 << bits, _NONE), np.full(1 << bits, -1, np.int64)
        for key, slot, following in zip(keys.tolist(), self._slot(keys).tolist(), known.values(), strict=True):
            while self.keys[slot] != _NONE:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.next[slot] = key, following

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The states that follow, -1 where no piece goes on so."""
        keys = (states.astype(np.uint64) << np.uint64(21)) | chars
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.next[slot], -1)
        open_ = np.flatnonzero((there != keys) & (there != _NONE))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            there = self.keys[slot[open_]]
            out[open_] = np.where(there == keys[open_], self.next[slot[open_]], -1)
            open_ = open_[(there != keys[open_]) & (there != _NONE)]
        return out


_NONE = np.uint64(2**64 - 1)
_READ: dict[str, Vocabulary] = {}


def vocabulary(model_file: str) -> Vocabulary:
    """Read once by a worker; the last entry is the end of a text."""
    if model_file not in _READ:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_file)
        size = sp.get_piece_size()
        usable = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        rank = np.array([size if sp.is_byte(i) else max(0.0, -sp.get_score(i)) for i in usable] + [0.0])
        byte = np.array([int(sp.id_to_piece(i)[3:5], 16) if sp.is_byte(i) else -1 for i in usable] + [-1])
        weight = 1 / (rank + 10)
        _READ[model_file] = Vocabulary([None if sp.is_byte(i) else sp.id_to_piece(i) for i in usable] + [None], byte, weight / weight.sum())
    return _READ[model_file]


def piece_logs(own: Vocabulary, counts: np.ndarray) -> np.ndarray:
    """Natural-log probability of each entry from its (expected) count and the prior."""
    return np.log((counts + PRIOR * own.weight) / (counts.sum() + PRIOR))


def build_pieces(model_file: str, logs: np.ndarray) -> Pieces:
    own = vocabulary(model_file)
    text = {t: p for t, p in zip(own.text, logs.tolist(), strict=True) if t}
    byte = [math.log(1 / len(logs))] * 256
    for b, p in zip(own.byte.tolist(), logs.tolist(), strict=True):
        if b >= 0:
            byte[b] = p
    return Pieces(text, byte, float(logs[-1]), max(map(len, text)))


class Lattices:
    """Sums over all segmentations, of many words at once."""

    def __init__(self, model_file: str, logs: np.ndarray):
        self.own, self.logs, self.pieces = vocabulary(model_file), logs, build_pieces(model_file, logs)
        self.entry = np.full(256, -1)
        self.entry[self.own.byte[self.own.byte >= 0]] = np.flatnonzero(self.own.byte >= 0)

    def _edges(self, chars: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray | None]]:
        """(from, to, words, log probabilities, entries) of the lattices' edges, by where they begin; words by time.

        A character that is no piece is spelled by its bytes: one edge without an entry.
        """
        steps, n = chars.shape
        for i in range(steps):
            words, states = np.arange(n), np.zeros(n, np.int64)
            for to in range(i + 1, steps + 1):
                states = self.own.step(states, chars[to - 1, words])
                entry = np.where(states >= 0, self.own.accept[states], -1)
                if to == i + 1 and len(at := np.flatnonzero(entry < 0)):
                    values, inverse = np.unique(chars[i, at], return_inverse=True)
                    spelled = np.array([sum(self.pieces.byte[b] for b in chr(c).encode()) for c in values.tolist()])
                    yield i, to, at, spelled[inverse], None
                found = np.flatnonzero(entry >= 0)
                if len(found):
                    yield i, to, words[found], self.logs[entry[found]], entry[found]
                alive = states >= 0
                words, states = words[alive], states[alive]
                if not len(words):
                    break

    def forward(self, chars: np.ndarray, keep: list | None = None) -> np.ndarray:
        alpha = np.full((len(chars) + 1, chars.shape[1]), -np.inf)
        alpha[0] = 0
        for edge in self._edges(chars):
            i, to, words, log, _ = edge
            alpha[to, words] = np.logaddexp(alpha[to, words], alpha[i, words] + log)
            if keep is not None:
                keep.append(edge)
        return alpha

    def expect(self, chars: np.ndarray, times: np.ndarray, counts: np.ndarray) -> None:
        """Add to counts how often each entry is expected in the words, each taken so many times."""
        edges: list = []
        alpha = self.forward(chars, edges)
        beta = np.full(alpha.shape, -np.inf)
        beta[-1] = 0
        for i, to, words, log, _ in reversed(edges):
            beta[i, words] = np.logaddexp(beta[i, words], beta[to, words] + log)
        for i, to, words, log, entry in edges:
            share = np.exp(alpha[i, words] + log + beta[to, words] - alpha[-1, words]) * times[words]
            if entry is not None:
                np.add.at(counts, entry, share)
            else:
                for c, x in zip(chars[i, words].tolist(), share.tolist(), strict=True):
                    for b in chr(c).encode():
                        if self.entry[b] >= 0:
                            counts[self.entry[b]] += x

    def groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, characters by time) of marked words of one length; words over LONG one by one."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order])) + 1
        for same in np.split(order, cuts) if len(order) else ():
            size = int(sizes[same[0]])
            step = TOGETHER if size <= LONG else 1
            for lo in range(0, len(same), step):
                at = same[lo : lo + step]
                own = np.empty((size + 1, len(at)), np.uint64)
                own[0] = ord(MARK)
                own[1:] = flat[starts[at] + np.arange(size)[:, None]]
                yield at, own

    def scores(self, words: list[str]) -> np.ndarray:
        """log10 of each word's probability."""
        out = np.empty(len(words))
        for at, chars in self.groups(words):
            if len(chars) > LONG + 1:
                out[at] = self.pieces.word(words[int(at[0])])
            else:
                out[at] = self.forward(chars)[-1] / math.log(10)
        return out


def _number(id_type: pa.DataType):
    names = ["kind", "block", "doc_id", "learn", "ids", "word", "place", "n"]
    types = [pa.int32(), pa.int64(), id_type, pa.bool_(), pa.binary(), pa.string(), pa.int32(), pa.int64()]

    def rows(kind: int, size: int, /, **columns) -> pa.RecordBatch:
        columns["kind"] = pa.array([kind] * size, pa.int32())
        return pa.RecordBatch.from_arrays([columns.get(x, pa.nulls(size, t)) for x, t in zip(names, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        known: dict[int, int] = {}
        words_of: list[bytes] = []
        counts, total = np.zeros(1 << 16, np.int64), 0

        def close() -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(words_of), 50_000):
                part = words_of[lo : lo + 50_000]
                n = len(part)
                yield rows(1, n, block=pa.array([block] * n, pa.int64()), word=pa.array([w.decode() for w in part], pa.string()), place=pa.array(np.arange(lo, lo + n, dtype=np.int32)), n=pa.array(counts[lo : lo + n]))

        for batch in batches:
            for lo, texts in text_batches(batch):
                words = split_words(texts, SPACED)
                distinct, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
                keys = distinct.tolist()
                for k in [k for k, h in enumerate(keys) if h not in known]:
                    known[keys[k]] = len(words_of)
                    words_of.append(words.word(first[k]))
                while len(words_of) > len(counts):
                    counts = np.concatenate([counts, np.zeros_like(counts)])
                ids = np.array([known[h] for h in keys], np.int32)[inverse]
                n = len(texts)
                learn = batch.column(2).slice(lo, n)
                taught = learn.fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
                counts += np.bincount(ids[taught[words.doc]], minlength=len(counts))
                bounds = words.bounds()
                own = [ids[bounds[k] : bounds[k + 1]].astype("<i4").tobytes() for k in range(n)]
                yield rows(0, n, block=pa.array([block] * n, pa.int64()), doc_id=batch.column(0).slice(lo, n).cast(id_type), learn=pa.array(taught), ids=pa.array(own, pa.binary()))
                total += len(ids)
                if total >= BLOCK_WORDS or len(words_of) >= BLOCK_DISTINCT:
                    yield from close()
                    block, total = block + 1, 0
                    known.clear()
                    words_of.clear()
                    counts[:] = 0
        yield from close()

    return run


def _expected(model_file: str, logs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices, counts = Lattices(model_file, logs), np.zeros(len(logs))
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            for at, chars in lattices.groups(batch.column(0).to_pylist()):
                lattices.expect(chars, n[at], counts)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["piece", "n"])

    return run


def _score_words(model_file: str, logs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(model_file, logs)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lattices.scores(batch.column(0).to_pylist()))], ["word", "c", "lattice"])

    return run


def learn_pieces(counts: DataFrame, model_file: str, ends: int, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the vocabulary's entries after ``rounds`` over (word, c) training counts."""
    own = vocabulary(model_file)
    logs = np.log(own.weight)
    for _ in range(rounds):
        expected = counts.mapInArrow(lean(_expected(model_file, logs)), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        held = np.zeros(len(logs))
        for r in expected.collect():  # a row for each piece at most
            held[r["piece"]] = r["n"]
        held[-1] = ends
        logs = piece_logs(own, held)
    return logs


def _score_docs(id_type: pa.DataType, denominator: int, ends: int, end: float):
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        size = words.num_rows
        c, lattice = np.zeros(size, np.int64), np.zeros(size)
        place = words.column("place").to_numpy()
        c[place], lattice[place] = words.column("c").to_numpy(), words.column("lattice").to_numpy()
        base = np.log10((c + 1) / denominator)
        ids = [np.frombuffer(b, "<i4") for b in docs.column("ids").to_pylist()]
        return pa.table(
            {
                "doc_id": docs.column("doc_id").cast(id_type), "learn": docs.column("learn"),
                "n_tokens": pa.array([len(x) + 1 for x in ids], pa.int64()), "n_known": pa.array([int((c[x] > 0).sum()) + (ends > 0) for x in ids], pa.int64()),
                "base_score": pa.array([float(base[x].sum()) + math.log10((ends + 1) / denominator) for x in ids], pa.float64()),
                "score": pa.array([float(lattice[x].sum()) + end / math.log(10) for x in ids], pa.float64()),
            }
        )

    return run


@only_result
def score_texts(docs: DataFrame, learn: Column, model_file: str, *, rounds: int = ROUNDS) -> DataFrame:
    """log10 probability of every row's whole text under a model learned from the rows where ``learn`` holds.

    docs: doc_id and text; other columns are ignored. Tokens are words (A-Z lower-cased, split at ASCII white
    space) and one end mark. Returns doc_id, learn, n_tokens, n_known (tokens seen in training), train_tokens,
    base_score (unigram with one added to counts, one unseen kind) and score (the lattice model's).

    Null and empty texts are the end mark alone. A null ``learn`` does not learn. Repeated rows count and are
    scored each. If nothing may be learned, the vocabulary's ranks alone give the probabilities. ``rounds``: of
    expectation and maximisation over all training words.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", learn.alias("learn"))
    kind = docs.schema["doc_id"].dataType
    id_sql, id_type = kind.simpleString(), to_arrow_type(kind)
    schema = f"kind int, block long, doc_id {id_sql}, learn boolean, ids binary, word string, place int, n long"
    numbered = materialise(docs.mapInArrow(lean(_number(id_type)), schema), "numbered", partition_by="kind")
    texts = numbered.filter("kind = 0").select("block", "doc_id", "learn", "ids")
    words = numbered.filter("kind = 1").select("block", "place", "word", "n")
    ends = texts.filter("learn").count()
    counts = materialise(words.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    drop_spent_shuffles(spark)
    seen = counts.filter("c > 0")
    sums = seen.agg(F.sum("c"), F.count("*")).first()
    tokens, distinct = (sums[0] or 0) + ends, sums[1] + (ends > 0)
    logs = learn_pieces(seen, model_file, ends, rounds)
    scored = counts.mapInArrow(lean(_score_words(model_file, logs)), "word string, c long, lattice double")
    scored = words.select("block", "place", "word").join(scored, "word").select(F.col("block").alias("of_block"), "place", "c", "lattice")
    out = f"doc_id {id_sql}, learn boolean, n_tokens long, n_known long, base_score double, score double"
    met = texts.groupBy("block").cogroup(scored.groupBy("of_block")).applyInArrow(_score_docs(id_type, tokens + distinct + 1, ends, float(logs[-1])), out)
    return met.select("doc_id", "learn", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
