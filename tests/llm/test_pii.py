import hashlib
import random
import re

import numpy as np
import pytest

from folioforge.llm import pii
from folioforge.llm.queries import QUERIES
from tests.conftest import TABLES

from .conftest import ODD

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    n = lambda s: re.sub("[^0-9]", "", s)
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(n(m[0])) <= 19 and pii.passes_luhn(n(m[0]))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(n(m[0])) <= 15]
    return sorted(found)


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice("aA0123456789.@-+% ()x1é") for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == plain(text), text
    for text in ("4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.256", "0000000000000000000001.2.3.4", "1.2.3.000000000000000000000256", "1.2.3.4.5.6.7.8", "a@b", "a@b.c@d.e", "+1 (415) 555-2671.", "+123"):
        assert pii.base_spans(text) == plain(text), text


def test_long_texts_are_linear():
    assert pii.base_spans("7" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == [] and pii.base_spans("@" * 50_000) == []


def test_gradients_are_the_slopes():
    rng = np.random.default_rng(3)
    e, trans, first = rng.normal(size=(5, 2, pii.N_TAGS)), rng.normal(size=(pii.N_TAGS, pii.N_TAGS)), rng.normal(size=pii.N_TAGS)
    tags = rng.integers(0, pii.N_TAGS, (5, 2))
    loss, de, dtrans, dfirst = pii.crf_gradients(e, trans, first, tags)
    for array, grad, at in ((e, de, (2, 1, 3)), (trans, dtrans, (1, 2)), (first, dfirst, (4,))):
        array[at] += 1e-6
        assert (pii.crf_gradients(e, trans, first, tags)[0] - loss) / 1e-6 == pytest.approx(grad[at], abs=1e-3)
        array[at] -= 1e-6


def test_decoding_is_the_best_legal_path():
    import itertools

    w = pii.init_weights(pii.Tagger(embedding=3, hidden=2))
    inputs = np.array([[5, 9, 30]])
    e, _ = pii.emissions(w, inputs.T)

    def score(path):
        if path[0] and path[0] % 2 == 0 or any(not pii.LEGAL[a, b] for a, b in zip(path, path[1:])):
            return -np.inf
        return w["first"][path[0]] + sum(e[t, 0, k] for t, k in enumerate(path)) + sum(w["trans"][a, b] for a, b in zip(path, path[1:]))

    best = max(itertools.product(range(pii.N_TAGS), repeat=3), key=score)
    assert tuple(pii.decode(w, inputs)[0]) == best


def samples(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    out = []
    for _ in range(n):
        kind = rng.choice([f"{word()}.{rng.randrange(99)}@{word()}.example.com", ".".join(str(rng.randrange(1, 255)) for _ in range(4)), f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"])
        out.append(" ".join([word() for _ in range(rng.randrange(3, 30))] + [kind] + [word() for _ in range(rng.randrange(3, 30))]))
    return out


def test_tagger_learns_from_labelled_spans(frame):
    model = pii.train_pii(frame(list(enumerate(samples(250, 1)))), how=pii.Tagger(epochs=6))
    held = samples(60, 2)
    found = pii.tagged_spans(model, held)
    assert sum(pii.base_spans(t) == f for t, f in zip(held, found, strict=True)) >= 45


@pytest.fixture(scope="module")
def trained(spark):
    return pii.train_pii(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]


def variants(n, seed):
    """Spans written into plain text in the makers' ways, none seen in training: (text, spans)."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        plain_text = " ".join(pii._name(rng) for _ in range(9))
        text, tags = pii._written_over(rng, plain_text, np.zeros(len(plain_text), np.int64))
        starts = [i for i, t in enumerate(tags) if t and t % 2 == 1]
        out.append((text, [(s, int(tags[s] - 1) // 2, next((e for e in range(s + 1, len(tags)) if tags[e] != tags[s] + 1), len(tags))) for s in starts]))
    return out


def test_precision_and_recall_on_held_out_variants(trained):
    held = variants(500, 77)
    found = pii.tagged_spans(trained, [t for t, _ in held])
    true = sum(s in f for (_, own), f in zip(held, found, strict=True) for s in own)
    assert true >= 0.8 * sum(len(own) for _, own in held) and true >= 0.8 * sum(map(len, found))
    missed = [(t, own, f) for (t, own), f in zip(held, found, strict=True) if own and own[0] not in pii.base_spans(t)]
    assert len(missed) > 150 and sum(own[0] in f for _, own, f in missed) >= 0.75 * len(missed)


def test_tagger_finds_what_patterns_label(trained, texts):
    """The patterns' own matches in the table, up to a window's reach."""
    texts = [t for t in texts if pii.base_spans(t)]
    found = pii.tagged_spans(trained, texts)
    base = [(k, s) for k, t in enumerate(texts) for s in pii.base_spans(t)]
    assert base and sum(s in found[k] for k, s in base) >= 0.8 * len(base)


def test_spans_are_added_on_the_table(trained, texts):
    added = [(t, s) for t in texts for s in pii.all_spans(pii.base_spans(t), pii.tagged_spans(trained, [t])[0]) if s not in pii.base_spans(t)]
    named = sum(len(pii._NAMED.findall(t)) for t in texts)
    assert named and sum(s[1] == 4 for _, s in added) >= 0.9 * named
    assert all(pii.valid(k, t[s:e]) for t, (s, k, e) in added)


def test_what_counts_as_a_span_has_a_trigger():
    """So that windows without one lose nothing: spans put together of all that makes them up, whole and in part."""
    rng = random.Random(9)
    parts = ["john", "a", "x1", "9", "@", " at ", "[at]", " (at) ", "( AT )", ".", " . ", ". ", " dot ", "[dot]", "(dot)", " [.] ", "com", "example", "-", "_", ":", " ", "+1", "(", ")", "fe80", "555", "1234"]
    held = [0] * len(pii.KINDS)
    for _ in range(200_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))
        for kind in range(len(pii.KINDS)):
            if pii.valid(kind, text):
                held[kind] += 1
                assert pii._TRIGGER.search(text), (kind, text)
    assert held[0] > 500 and held[1] and held[3]
    for text in ("john at example.com", "john [at] foo [dot] com", "john at foo[dot]com", "j.d (at) foo.example.com", "a dot b at foo dot com"):
        assert pii.valid(0, text) and pii.trigger_windows(text)
    for text in ("met at noon. then", "at the door", "look at it", "at foo", "the dot at the end"):
        assert not pii.valid(0, text)


def test_makers_make_valid_spans():
    rng = np.random.default_rng(4)
    for kind, maker in enumerate(pii._MAKERS):
        for text in (maker(rng) for _ in range(500)):
            assert pii.valid(kind, text), text


def test_windows_cover_every_trigger():
    rng = random.Random(6)
    for _ in range(200):
        text = "".join("7" if rng.random() < 0.02 else "x" for _ in range(rng.randrange(600)))
        starts = pii.trigger_windows(text)
        for m in re.finditer("7", text):
            assert any(s <= m.start() < s + pii.WINDOW for s in starts)


def test_odd_rows(frame):
    model = pii.train_pii(frame(ODD), how=pii.Tagger(epochs=1, examples=64))
    rows = pii.find_pii(frame(ODD), model).collect()
    expected = sorted(((i is None, i), plain(t or "")) for i, t in ODD)
    assert sorted(((r.doc_id is None, r.doc_id), [(s.start, pii.KINDS.index(s.kind), s.end) for s in r.base]) for r in rows) == expected
    assert pii.train_pii(frame([(1, None), (2, "")])) is None
    assert pii.find_pii(frame([]), None).collect() == []


def test_mask(frame):
    assert pii.mask("x a@b.cc y", [(2, 0, 8)]) == "x [EMAIL] y"
    docs = frame([(1, "mail a@b.cc"), (2, None), (3, "")])
    rows = pii.mask_pii(docs, None)
    assert rows.columns == docs.columns and {r.doc_id: r.text for r in rows.collect()} == {1: "mail [EMAIL]", 2: None, 3: ""}


def test_query_base_equals_the_patterns(spark, documents):
    for r in QUERIES["op9_pii"](spark, TABLES).collect():
        base = plain(documents[r.doc_id])
        listed = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(",")) | {""}
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for _, k, _ in base) for n in range(4))
