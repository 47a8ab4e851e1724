import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm.neighbours import fit_tree, nearest_neighbours
from folioforge.llm.queries import QUERIES
from tests.conftest import TABLES


@pytest.fixture
def table(spark):
    def make(rows):
        return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, leaf string, rank int").repartition(2)

    return make


def brute(rows, k, every):
    out = {}
    for i, v in rows:
        if i % every == 0:
            scored = sorted((-float((np.float64(v) * np.float64(w)).sum()), j) for j, w in rows if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, expected):
    hit = sum(len({j for j, _ in got.get(q, [])} & {j for j, _ in best}) for q, best in expected.items())
    return hit / max(1, sum(map(len, expected.values())))


def test_exact_with_full_recall(table):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=6).astype(np.float32)]) for k in range(60)]
    got, expected = found(nearest_neighbours(table(rows), F.col("vec_id") % 5 == 0, neighbours=7, recall=1.0)), brute(rows, 7, 5)
    assert {q: [j for j, _ in b] for q, b in got.items()} == {q: [j for j, _ in b] for q, b in expected.items()}


def clustered(n, dims, seed, centres=12):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    x = c[rng.integers(0, centres, n)] + 0.35 * rng.normal(size=(n, dims))
    return [(k, [float(v) for v in row]) for k, row in enumerate((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32))]


def test_recall_with_many_more_leaves_than_visits(table, monkeypatch):
    from folioforge.llm import neighbours

    trees = []
    monkeypatch.setattr(neighbours, "fit_tree", lambda *a, **b: trees.append(fit_tree(*a, **b)) or trees[-1])
    rows = clustered(6000, 8, 5)
    got = found(nearest_neighbours(table(rows), F.col("vec_id") % 40 == 0, neighbours=10))
    assert recall(got, brute(rows, 10, 40)) >= 0.9
    assert trees[0].leaves > 100 and trees[0].visits * 5 < trees[0].leaves


def test_small_cells_give_the_same(table, monkeypatch):
    from folioforge.llm import neighbours

    rows = clustered(600, 5, 4)
    whole = found(nearest_neighbours(table(rows), F.col("vec_id") % 10 == 0, neighbours=5))
    monkeypatch.setattr(neighbours, "CELL", 50)
    assert found(nearest_neighbours(table(rows), F.col("vec_id") % 10 == 0, neighbours=5)) == whole


def test_tree_goes_on_inside_large_leaves(table):
    """A sample far smaller than the table: leaves of hundreds of rows, each searched as a tree."""
    rows = clustered(4000, 8, 6)
    got = found(nearest_neighbours(table(rows), F.col("vec_id") % 40 == 0, neighbours=10, sample=60, recall=0.97, subtree=100))
    assert recall(got, brute(rows, 10, 40)) >= 0.9


def test_cells_hold_whole_subtrees():
    x = np.random.default_rng(3).normal(size=(2000, 4))
    tree = fit_tree(x, neighbours=5, recall=0.9, leaf_size=10)
    held = np.bincount(tree.assign(x), minlength=tree.leaves)
    cells = tree.cells(held, 300)
    sizes = np.bincount(cells, held)
    assert sizes.sum() == 2000 and sizes.max() <= 300 and (sizes > 0).sum() < tree.leaves


def test_many_equal_vectors_tie_to_small_ids(table):
    rows = [(k, [1.0, 0.0]) for k in range(5000)] + [(6000 + k, [0.0, 1.0]) for k in range(10)]
    got = found(nearest_neighbours(table(rows), F.col("vec_id") % 2500 == 0, neighbours=5))
    assert [j for j, _ in got[0]] == [1, 2, 3, 4, 5] and [j for j, _ in got[2500]] == [0, 1, 2, 3, 4]


def test_a_common_vector_is_searched_once(table):
    """A third of all rows share a vector: as candidates and as queries."""
    rows = [(3 * k, [1.0, 1.0]) for k in range(400)] + [(3 * k + 1, [float(k % 7), 1.0]) for k in range(400)]
    got = found(nearest_neighbours(table(rows), F.col("vec_id") % 2 == 0, neighbours=4, recall=1.0))
    assert got == brute(rows, 4, 2)


def test_ids_of_several_vectors_are_listed_once(table):
    rows = [(0, [1.0, 0.0]), *((1, [k / 50, 1.0]) for k in range(50)), (2, [0.5, 0.0]), (3, [0.2, 0.1])]
    got = found(nearest_neighbours(table(rows), F.col("vec_id") == 0, neighbours=3, recall=1.0))[0]
    assert [j for j, _ in got] == [1, 2, 3] and abs(got[0][1] - 0.98) < 1e-6


def test_odd_rows(table):
    rows = [(0, [1.0, 2.0]), (20, None), (40, []), (60, [0.0, 0.0]), (80, [float("nan"), 1.0]), (100, [None, 1.0]), (120, [float("inf"), 1.0]), (140, [1.0]), (None, [1.0, 1.0]), (3, [2.0, 1.0]), (3, [2.0, 1.0]), (160, [1.0, 0.0])]
    got = found(nearest_neighbours(table(rows), F.col("vec_id") % 20 == 0))
    assert got == {0: [(3, 4.0), (160, 1.0)], 160: [(3, 2.0), (0, 1.0)]}
    assert nearest_neighbours(table([]), F.col("vec_id") % 20 == 0).collect() == []
    assert nearest_neighbours(table([(7, [1.0])]), F.col("vec_id") % 20 == 0).collect() == []


def test_tree_leads_each_vector_to_its_leaf():
    x = np.random.default_rng(2).normal(size=(3000, 8))
    tree = fit_tree(x, neighbours=10, recall=0.9, leaf_size=60)
    leaves = tree.assign(x)
    assert tree.leaves > 3 and 1 <= tree.visits <= tree.leaves and leaves.max() < tree.leaves
    held = np.bincount(leaves, minlength=tree.leaves)
    seen = tree.visited(x[0], held, 10)
    assert len(seen) == max(tree.visits, len(seen)) and sum(held[seen]) >= 10
    assert sorted(tree.order(x[0])) == list(range(tree.leaves)) and next(iter(tree.order(x[0]))) in leaves


def test_query_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{TABLES}/embeddings.parquet").collect()]
    got, expected = found(QUERIES["op5_nearest_neighbours"](spark, TABLES)), brute(rows, 20, 20)
    assert set(got) == set(expected) and all(len(b) == 20 for b in got.values())
    assert recall(got, expected) >= 0.9
    scores = dict(rows)
    for q, best in got.items():
        for j, s in best:
            assert abs(s - float((np.float64(scores[q]) * np.float64(scores[j])).sum())) < 1e-12
