import random

import numpy as np
from pyspark.sql import functions as F

from folioforge.llm.components import connected_components
from folioforge.llm.jaccard import jaccard_components, signature
from folioforge.llm.queries import ORACLES, QUERIES
from tests.conftest import TABLES

from .conftest import ODD


def sets(texts):
    out = []
    for i, t in texts:
        w = (t or "").encode().lower().split()
        out.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    return out


def brute(texts):
    own = sets(texts)
    root = list(range(len(own)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(own)):
        for b in range(a):
            x, y = own[a][1], own[b][1]
            k = len(x & y)
            if k and 100 * k >= 80 * (len(x) + len(y) - k):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(own):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i is None, i), len(s), least.get(find(k))) for k, (i, s) in enumerate(own))


def found(rows):
    return sorted(((r.doc_id is None, r.doc_id), r.n_shingles, r.component_id) for r in rows)


def test_odd_rows(frame):
    assert found(jaccard_components(frame(ODD)).collect()) == brute(ODD)


def test_empty_table(frame):
    assert jaccard_components(frame([])).collect() == []


def test_near_copies_chains_and_boilerplate(frame):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    common = " ".join(rng.choice(words) for _ in range(30))
    texts = []
    for group in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([6, 12, 40, 120]))]
        for _ in range(rng.choice([1, 2, 8, 20])):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append((len(texts), " ".join(own) + (" " + common if rng.random() < 0.3 else "")))
    chain = [rng.choice(words) for _ in range(60)]
    for _ in range(10):  # each near the next, the ends far apart
        texts.append((len(texts), " ".join(chain)))
        chain = [*chain[3:], *(rng.choice(words) for _ in range(3))]
    assert found(jaccard_components(frame(texts)).collect()) == brute(texts)


def test_query_equals_brute_force(spark, documents):
    assert found(QUERIES["op2_ngram_jaccard_join"](spark, TABLES).collect()) == brute(list(documents.items()))


def test_query_equals_its_sql(same):
    same(QUERIES["op2_ngram_jaccard_join"], ORACLES["op2_ngram_jaccard_join"])


def test_signatures_bound_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a = np.unique(rng.integers(-(2**62), 2**62, 200))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.8], rng.integers(-(2**62), 2**62, 30)]))
        apart = sum(int(x).bit_count() for x in (signature(a) ^ signature(b)).view(np.uint64).tolist())
        assert apart <= len(np.setxor1d(a, b))


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(3, 3), (None, 1)]
    rows = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in rows} == {k: 100 for k in range(101, 161)} | {k: 7 for k in range(200, 260)}
    none = connected_components(spark.createDataFrame([], "a long, b long").select(F.col("a"), F.col("b")))
    assert none.collect() == []


def test_components_ignore_other_columns(spark):
    rows = spark.createDataFrame([(1, 2, "x", 9, 5), (2, 3, "y", 9, 5)], "a long, b long, m string, d long, root long")
    assert {r.node: r.root for r in connected_components(rows).collect()} == {2: 1, 3: 1}


def test_one_document_near_a_third_of_all(frame):
    """A star in the links, a hot n-gram in the lists, and copies without end."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(50)]
    texts = [(k, " ".join(base)) for k in range(60)]
    for k in range(80):
        own = list(base)
        own[rng.randrange(50)] = f"x{k}"
        texts.append((100 + k, " ".join(own)))
    texts += [(300 + k, " ".join([*base[:8], *(f"y{k}_{j}" for j in range(40))])) for k in range(100)]
    assert found(jaccard_components(frame(texts)).collect()) == brute(texts)
