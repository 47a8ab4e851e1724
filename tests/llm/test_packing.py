import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioforge.llm.packing import pack_documents, plan_sequences
from folioforge.llm.queries import QUERIES
from folioforge.llm.tokens import RunEncoder
from tests.conftest import TABLES

from .conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
@settings(max_examples=200, deadline=None)
def test_plan_holds_every_piece_once(histogram):
    plan = plan_sequences(histogram, 64)
    used = Counter()
    for times, line in plan:
        assert times > 0 and sum(n * k for n, k in line) <= 64
        for n, k in line:
            used[n] += k * times
    assert used == Counter(histogram)


def test_plan_finds_exact_complements():
    full = plan_sequences({40: 5, 24: 5, 30: 4, 20: 4, 14: 4, 10: 8}, 64)
    assert sum(t for t, _ in full) == 5 + 4 + 2  # pairs, triples, and what is left of the tens


def test_plan_has_few_lines_for_many_pieces():
    assert len(plan_sequences(dict.fromkeys(range(1, 2049), 10**9), 2048)) < 8000


def test_plan_rejects_what_cannot_fit():
    with pytest.raises(ValueError):
        plan_sequences({65: 1}, 64)


def test_ids_are_the_tokenizers():
    tokenizer, encoder = Tokenizer.from_file(PATH), RunEncoder(PATH)
    texts = ["", "It's THE end, isn't it?! É, é. a× ÷. 12,5 — x", "a b c", "<|endoftext|> The, <|ENDOFTEXT|>", "x" * 3000, "mm. " * 50, "é. É,"]
    flat, bounds = encoder.encode([t.encode() for t in texts])
    for k, t in enumerate(texts):
        assert flat[bounds[k] : bounds[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_ids_stay_right_when_runs_are_forgotten(monkeypatch):
    from folioforge.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 60)
    monkeypatch.setattr(tokens, "RECENT", 15)
    rng, tokenizer, encoder = np.random.default_rng(3), Tokenizer.from_file(PATH), RunEncoder(PATH)
    for _ in range(40):
        texts = [" ".join(f"word{rng.zipf(1.3) % 500}" for _ in range(30)) for _ in range(3)]
        flat, bounds = encoder.encode([t.encode() for t in texts])
        for k, t in enumerate(texts):
            assert flat[bounds[k] : bounds[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def check(rows, texts, capacity=2048):
    """The pieces of every text, gapless sequences, and how many there are."""
    tokenizer = Tokenizer.from_file(PATH)
    found = sorted((r.doc_id is None, r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    expected = []
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        expected += [(i is None, i, k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
    assert found == sorted(expected)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_odd_rows(frame):
    rows = pack_documents(frame(ODD), PATH, payload={"ids_crc32": F.crc32("ids")}).collect()
    assert check(rows, ODD) >= 1


def test_empty_table(frame):
    assert pack_documents(frame([]), PATH).collect() == []


def test_query_over_all_documents(spark, documents):
    rows = QUERIES["op1_best_fit_packing"](spark, TABLES).collect()
    n = check(rows, list(documents.items()))
    assert n <= -(-sum(r.length for r in rows) // 2048) + 1
