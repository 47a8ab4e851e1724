import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from folioforge.llm.queries import QUERIES
from folioforge.llm.toxicity import Ftrl, _pack, _unpack, add_toxicity, features, fit_ftrl, score_toxicity, train_toxicity
from folioforge.llm.words import ALNUM, split_words
from tests.conftest import TABLES

from .conftest import ODD


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(n):
        toxic = k % 5 == 0
        own = [rng.choice(words) for _ in range(rng.randrange(20, 60))]
        if toxic:
            for _ in range(3):
                own[rng.randrange(len(own))] = rng.choice(["vile", "nasty", "rude"])
        rows.append((k, " ".join(own), int(toxic)))
    return rows


def test_held_out_accuracy(spark, frame):
    rows = corpus()
    docs = frame([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows if i < 200], "doc_id long, toxic int, text string")
    model = train_toxicity(docs, labels, how=Ftrl(l1=2.0))
    assert len(model) < 300  # sparse
    found = {r.doc_id: r.score for r in score_toxicity(docs, model).collect()}
    held = [(found[i], y) for i, _, y in rows if i >= 200]
    assert sum((s >= 0.3) == bool(y) for s, y in held) >= 0.95 * len(held)


def test_odd_rows_and_labels(spark, frame):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (5, 7), (8, 0), (8, 0)], "doc_id long, toxic int")
    model = train_toxicity(frame(ODD), labels)
    rows = score_toxicity(frame(ODD), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1


def test_without_labels_or_documents(spark, frame):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [round(r.score, 6) for r in score_toxicity(frame(ODD[:1]), train_toxicity(frame(ODD), none)).collect()] == [0.05]
    assert score_toxicity(frame([]), {0: 0.0}).collect() == []


def test_features_stay_within_a_text():
    one = features(split_words([b"a b c d"], ALNUM))[1]
    both_docs, both = features(split_words([b"a b", b"c d"], ALNUM))
    assert len(one) == 4 + 3 + 2 + 2 + 1 and len(both) == 2 * (2 + 1)
    assert set(both[both_docs == 0]) <= set(one)


def plain_ftrl(labels, examples, how):
    """FTRL-proximal one coordinate at a time, as published; coordinate 0 is in every example and has no L1."""
    often = Counter(i for own in examples for i in own)
    rate = (sum(labels) + how.prior * 20) / (len(labels) + 20)
    z, n = {0: -math.log(rate / (1 - rate)) * (how.beta / how.alpha + how.l2)}, {}

    def weight(i):
        l1 = how.l1 if i else 0.0
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((how.beta + math.sqrt(n.get(i, 0.0))) / how.alpha + how.l2)

    for _ in range(how.epochs):
        for y, own in zip(labels, examples):
            own = [0, *(i for i in own if often[i] >= how.examples)]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in own:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / how.alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: w for i in z if (w := weight(i)) or i == 0}


def packed(own, bits):
    return np.frombuffer(_pack(np.array(own, np.int64), bits), "<u2")


def test_packed_indices_come_back():
    own = [1, 2, 65_535, 65_536, 65_537, 1_048_575]
    assert _unpack(packed(own, 20), 20).tolist() == own and _unpack(packed([], 20), 20).tolist() == [] and _unpack(packed([3, 9], 10), 10).tolist() == [3, 9]


@pytest.mark.parametrize("how", [Ftrl(l1=0.3, examples=2), Ftrl(l1=1.0, alpha=0.5, examples=1, epochs=2)])
def test_fit_equals_plain_ftrl(how):
    rng = random.Random(8)
    examples = [sorted(rng.sample(range(1, 60), rng.randrange(0, 12))) for _ in range(200)]
    labels = [int(5 in own or rng.random() < 0.1) for own in examples]
    found, expected = fit_ftrl(labels, [packed(own, 6) for own in examples], how, 6), plain_ftrl(labels, examples, how)
    assert found.keys() == expected.keys()
    assert all(found[i] == pytest.approx(w, rel=1e-9) for i, w in expected.items())


def plain_grams(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    out = {(1, w) for w in words}
    for kind, places in ((2, (0, 1)), (3, (0, 1, 2)), (4, (0, 2)), (5, (0, 3))):
        out |= {(kind, *(words[k + p] for p in places)) for k in range(len(words) - places[-1])}
    return out


def test_scores_equal_a_sum_over_the_grams(spark, frame):
    """Every gram's weight is found through a text that holds nothing else besides its parts' grams."""
    model = train_toxicity(frame([(i, t) for i, t, _ in corpus(120)]), spark.createDataFrame([(i, y) for i, _, y in corpus(120)], "doc_id long, toxic int"), how=Ftrl(l1=0.5, examples=1))
    texts = {i: t for i, t, _ in corpus(12, seed=9)}
    index = {}
    for t in texts.values():
        for gram in plain_grams(t):
            kind, *own = gram
            fill = {1: [], 2: [], 3: [], 4: ["qq"], 5: ["qq", "rr"]}[kind]
            words = split_words([" ".join([own[0], *fill, *own[1:]]).encode()], ALNUM)
            n = len(words.hash)
            at = {1: n, 2: n + n - 1, 3: 3 * n - 3, 4: 2 * n - 1 + max(0, n - 2) + 1, 5: 2 * n - 1 + (n - 2) + (n - 2) + 1}[kind] - 1
            index[gram] = int(features(words)[1][at])
    scored = {r.doc_id: r.score for r in score_toxicity(frame(list(texts.items())), model).collect()}
    for i, t in texts.items():
        total = model[0] + sum(model.get(k, 0.0) for k in {index[g] for g in plain_grams(t)})
        assert scored[i] == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-9)


def test_weights_are_zero_for_rare_features():
    model = fit_ftrl([1, 0] * 2, [packed(own, 10) for own in ([5, 9], [9])] * 2, Ftrl(examples=3, l1=0.1), 10)
    assert 5 not in model


def test_every_column_stays(frame):
    docs = frame(ODD)
    rows = add_toxicity(docs, {0: 0.0}, "toxicity")
    assert rows.columns == [*docs.columns, "toxicity"] and sorted(map(str, rows.drop("toxicity").collect())) == sorted(map(str, docs.collect()))


def test_query(spark, documents):
    rows = QUERIES["op4_toxicity"](spark, TABLES).collect()
    assert len(rows) == len(documents) and all(r.predicted == int(r.score >= 0.3) for r in rows)
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in documents}
