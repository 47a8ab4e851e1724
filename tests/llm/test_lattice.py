import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from folioforge.llm import lattice
from folioforge.llm.queries import QUERIES
from tests.conftest import TABLES

from .conftest import ODD

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def base(texts, learn):
    counts, ends = Counter(), 0
    for i, t in texts:
        if learn(i):
            counts.update((t or "").encode().lower().split())
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    out = []
    for i, t in texts:
        own = (t or "").encode().lower().split()
        score = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own) + math.log10((ends + 1) / (n + v + 1))
        out.append(((i is None, i), len(own) + 1, sum(counts[w] > 0 for w in own) + (ends > 0), n, round(score, 5)))
    return sorted(out)


def found(rows):
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    return sorted(((r.doc_id is None, r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows)


def some_logs(seed=1):
    own = lattice.vocabulary(MODEL)
    counts = np.zeros(len(own.weight))
    at = np.random.default_rng(seed).choice(len(counts), 300, replace=False)
    counts[at] = 50
    return lattice.piece_logs(own, counts)


@pytest.fixture(scope="module")
def pieces():
    return lattice.build_pieces(MODEL, some_logs())


def segmentations(pieces, word):
    """(probability, pieces or bytes) of every way to cut the marked word."""
    s = lattice.MARK + word
    for cuts in itertools.product([0, 1], repeat=len(s) - 1):
        parts, at = [], 0
        for k, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(s[at:k])
                at = k
        p, used = 0.0, []
        for part in parts:
            if part in pieces.log:
                p += pieces.log[part]
                used.append(part)
            elif len(part) == 1:
                p += sum(pieces.byte[b] for b in part.encode())
                used += list(part.encode())
            else:
                break
        else:
            yield math.exp(p), used


WORDS = ["the", "ab", "hello", "ñandú", "中", "áb", "", "wordle", "x\u0301y", "🙂ok"]


@pytest.mark.parametrize("word", WORDS)
def test_word_sums_all_segmentations(pieces, word):
    total = sum(p for p, _ in segmentations(pieces, word))
    assert pieces.word(word) == pytest.approx(math.log10(total), rel=1e-9)
    assert lattice.Lattices(MODEL, some_logs()).scores([word])[0] == pytest.approx(math.log10(total), rel=1e-9)


def test_words_together_score_as_one_by_one(pieces):
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshr ñé中-'9") for _ in range(rng.randrange(0, 90))) for _ in range(300)] + WORDS
    assert lattice.Lattices(MODEL, some_logs()).scores(words) == pytest.approx([pieces.word(w) for w in words], rel=1e-9)


def test_expected_counts_sum_over_all_segmentations(pieces):
    lattices, own = lattice.Lattices(MODEL, some_logs()), lattice.vocabulary(MODEL)
    name = [t if t else int(b) if b >= 0 else None for t, b in zip(own.text, own.byte)]
    expected, found = Counter(), np.zeros(len(name))
    times = [3, 1, 2, 5, 1, 4, 2, 1, 1, 2]
    for word, n in zip(WORDS, times):
        ways = list(segmentations(pieces, word))
        total = sum(p for p, _ in ways)
        for p, used in ways:
            for x in used:
                expected[x] += n * p / total
    for at, chars in lattices.groups(WORDS):
        lattices.expect(chars, np.array(times, float)[at], found)
    assert {name[i]: found[i] for i in np.flatnonzero(found)} == pytest.approx({k: v for k, v in expected.items() if k in set(name)}, rel=1e-6)


def test_rounds_raise_the_likelihood(spark, documents):
    """Expectation and maximisation: better on the words learned from, and on held-out texts too."""
    split = [[w for i, t in documents.items() if (i % 7 == 2) == held for w in t.encode().lower().decode().split()] for held in (False, True)]
    counts = spark.createDataFrame(list(Counter(split[0]).items()), "word string, c long")
    scores = []
    for rounds in range(4):
        lattices = lattice.Lattices(MODEL, lattice.learn_pieces(counts, MODEL, 100, rounds))
        scores.append([lattices.scores(own).mean() for own in split])
    assert all(b[0] > a[0] and b[1] > a[1] for a, b in zip(scores, scores[1:]))


def test_long_words_do_not_underflow(pieces):
    assert math.isfinite(pieces.word("xq" * 5000))


def test_piece_probabilities_sum_to_one(pieces):
    assert sum(map(math.exp, pieces.log.values())) + sum(map(math.exp, pieces.byte)) + math.exp(pieces.end) == pytest.approx(1.0, rel=1e-6)


@pytest.mark.parametrize("bound", [3, 1 << 40])
def test_odd_rows_in_blocks_of_any_size(frame, monkeypatch, bound):
    monkeypatch.setattr(lattice, "BLOCK_DISTINCT", bound)
    rows = lattice.score_texts(frame(ODD), F.col("doc_id") % 2 == 1, MODEL).collect()
    assert found(rows) == base(ODD, lambda i: i is not None and i % 2 == 1)


def test_nothing_to_learn_and_empty_table(frame):
    assert found(lattice.score_texts(frame(ODD), F.lit(False), MODEL).collect()) == base(ODD, lambda i: False)
    assert lattice.score_texts(frame([]), F.lit(True), MODEL).collect() == []


def test_score_is_the_sum_of_words_and_end(frame):
    texts = {1: "the quick brown fox", 2: "", 3: "the the ñandú 中文 the", 4: "Quick  fox\n"}
    rows = {r.doc_id: r.score for r in lattice.score_texts(frame(list(texts.items())), F.col("doc_id") != 3, MODEL, rounds=2).collect()}
    learned = Counter(w for i, t in texts.items() if i != 3 for w in t.lower().split())
    own, logs = lattice.vocabulary(MODEL), np.log(lattice.vocabulary(MODEL).weight)
    for _ in range(2):
        held = np.zeros(len(logs))
        words = list(learned)
        lattices = lattice.Lattices(MODEL, logs)
        for at, chars in lattices.groups(words):
            lattices.expect(chars, np.array([learned[words[k]] for k in at], float), held)
        held[-1] = 3
        logs = lattice.piece_logs(own, held)
    final = lattice.build_pieces(MODEL, logs)
    assert rows == pytest.approx({i: sum(final.word(w) for w in t.lower().split()) + final.end / math.log(10) for i, t in texts.items()}, rel=1e-9)


def test_query(spark, documents):
    rows = QUERIES["op8_lm_scoring"](spark, TABLES).collect()
    assert found(rows) == base(list(documents.items()), lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in documents}
