import random
import re

import pytest

from folioforge.llm.decontamination import benchmark_hits
from folioforge.llm.queries import ORACLES, QUERIES

from .conftest import ODD


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items, window=13):
    out = []
    for i, t in texts:
        own, hit, held = words(t), set(), set()
        for name, body in items:
            w = words(body)
            n = min(window, len(w))
            if name is None or not n:
                continue
            for k in range(len(w) - n + 1):
                for at in range(len(own) - n + 1):
                    if own[at : at + n] == w[k : k + n]:
                        hit.update(range(at, at + n))
                        held.add(str(name))
        out.append(((i is None, i), len(own), len(hit), sorted(held)))
    return sorted(out)


def found(rows):
    for r in rows:
        assert sum(h.last - h.first + 1 for h in r.hits) == r.n_hit
    return sorted(((r.doc_id is None, r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in rows)


@pytest.fixture
def items(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice("abcdefgh") + str(rng.randrange(3)) for _ in range(rng.choice([1, 4, 5, 12, 13, 14, 30])))) for k in range(25)]
    rows += [(3, rows[3][1]), (90, None), (91, "..."), (None, "word"), (92, "The MIT"), (93, "one")]
    return rows, spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, doc_id string")


@pytest.mark.parametrize("slice_bytes", [1 << 20, 200])
def test_equals_brute_force(frame, items, slice_bytes):
    rng = random.Random(9)
    rows, benchmark = items
    texts = list(ODD)
    for k in range(40):
        own = [rng.choice("abcdefgh") + str(rng.randrange(3)) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            body = words(rng.choice(rows)[1])
            cut = body[rng.randrange(3) :]
            own[rng.randrange(len(own) + 1) : 0] = [w.upper() + "," for w in cut]
        texts.append((100 + k, " ".join(own)))
    assert found(benchmark_hits(frame(texts), benchmark, slice_bytes=slice_bytes).collect()) == brute(texts, rows)


def test_empty_tables(spark, frame, items):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(n, h) for _, n, h, _ in found(benchmark_hits(frame(ODD[:4]), none).collect())] == [(0, 0), (0, 0), (0, 0), (1, 0)]
    assert benchmark_hits(frame([]), items[1]).collect() == []


def test_query_equals_its_sql(same):
    same(QUERIES["op7_benchmark_decontamination"], ORACLES["op7_benchmark_decontamination"])
