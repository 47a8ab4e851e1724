"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

Equal vectors are one row of the index with the smallest ids that hold them, as many as an answer can list; equal
queries are searched once. So a vector that a third of all rows share is no more work than another.

The tree is fitted on one half of a bounded sample; every vector is put into the leaf that it descends to. Leaves
are small, in number proportional to the table. A query walks the tree with a priority queue of nodes by nearness
of their centres, taking the best node each time, until it has visited as many leaves as calibration on the
sample's other half found necessary for the recall asked for (and leaves enough for a full answer).

Subtrees of bounded size are cells: a query travels once to each cell in which it has leaves to visit, with their
list, and there only rows of these leaves are scored, a leaf at a time for all queries that visit it. Where the table
is so large against the sample that a single leaf exceeds a cell, its rows are dealt to several, and the tree goes on
inside the task: each is fitted, calibrated and searched in the same way. Cells return the best of each query with
exact scores on the original vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .memory import lean
from .scratch import materialise, only_result, smallest

#: Vectors that the tree is fitted and calibrated on at most (those with the smallest hash), in number and bytes.
SAMPLE, SAMPLE_BYTES = 100_000, 64 << 20
#: Sample vectors that calibration takes as queries at most.
CALIBRATION = 400
#: Children of a node; rows of the whole table that a leaf should hold; sample vectors it is fitted on at least.
BRANCHES, LEAF_ROWS, LEAST = 8, 32, 6
#: Rows of a cell, and queries that meet them in one task; rows from which a leaf is a tree of its own in the task.
CELL, SUBTREE = 8192, 1024
#: Queries whose walks are worth a task.
WALKS = 256
#: Products of queries and rows that a task holds at a time.
BLOCK = 1 << 21


@dataclass
class Tree:
    """Nodes in breadth-first order: centre, children (none: a leaf), number of the leaf."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: list[int]
    visits: int = 1

    @property
    def leaves(self) -> int:
        return max(self.leaf, default=-1) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row descends to: nearest child at every node."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            below = self.children[node]
            if not below:
                out[rows] = self.leaf[node]
                continue
            choice = _nearest(x[rows], self.centres[below])
            todo += [(child, rows[choice == i]) for i, child in enumerate(below) if (choice == i).any()]
        return out

    def order(self, q: np.ndarray, near: np.ndarray | None = None) -> Iterator[int]:
        """Leaves, best bin first: a queue of nodes by nearness of their centres, the nearest taken each time."""
        near = ((self.centres - q) ** 2).sum(axis=1) if near is None else near
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield self.leaf[node]
            for child in self.children[node]:
                heapq.heappush(queue, (float(near[child]), child))

    def visited(self, q: np.ndarray, held: Sequence[int], least: int, near: np.ndarray | None = None) -> list[int]:
        """The leaves with rows that a search visits: ``visits`` of them, and on until ``least`` rows are held.

        The walk of order(), which each query does by itself: nodes in the queue stand as their places by nearness,
        equally near ones by number, which compare faster than pairs.
        """
        near = ((self.centres - q) ** 2).sum(axis=1) if near is None else near
        nodes = np.argsort(near, kind="stable")
        places = np.empty_like(nodes)
        places[nodes] = np.arange(len(nodes))
        nodes, places = nodes.tolist(), places.tolist()
        children, leaf, visits, push, pop = self.children, self.leaf, self.visits, heapq.heappush, heapq.heappop
        out, enough, queue = [], 0, [places[0]]
        while queue:
            node = nodes[pop(queue)]
            below = children[node]
            if below:
                for child in below:
                    push(queue, places[child])
            elif held[leaf[node]]:
                out.append(leaf[node])
                enough += held[leaf[node]]
                if len(out) >= visits and enough >= least:
                    break
        return out

    def cells(self, held: np.ndarray, most: int) -> np.ndarray:
        """For each leaf its cell: the highest node above it whose leaves hold ``most`` rows at most."""
        rows = np.zeros(len(self.children), np.int64)
        for node in range(len(self.children) - 1, -1, -1):
            below = self.children[node]
            rows[node] = rows[below].sum() if below else held[self.leaf[node]]
        out, todo = np.zeros(self.leaves, np.int32), [(0, -1)]
        while todo:
            node, cell = todo.pop()
            cell = node if cell < 0 and (rows[node] <= most or not self.children[node]) else cell
            if not self.children[node]:
                out[self.leaf[node]] = cell
            todo += [(child, cell) for child in self.children[node]]
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


def _split(x: np.ndarray, rng: np.random.Generator) -> np.ndarray | None:
    """Clusters of the rows by a few rounds of k-means; None if they cannot be told apart."""
    distinct = np.unique(x, axis=0)
    if len(distinct) < 2:
        return None
    centres = distinct[rng.choice(len(distinct), min(BRANCHES, len(distinct)), replace=False)]
    for _ in range(10):
        choice = _nearest(x, centres)
        centres = np.array([x[choice == i].mean(axis=0) if (choice == i).any() else centres[i] for i in range(len(centres))])
    choice = _nearest(x, centres)
    return choice if len(np.unique(choice)) > 1 else None


def fit_tree(x: np.ndarray, *, neighbours: int, recall: float, leaf_size: int, seed: int = 11) -> Tree:
    """A tree of one half of the rows, with the leaf visits that reach the recall among the other half.

    Nodes of more than leaf_size rows are split, unless their rows are all the same.
    """
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    own, held_out = (x[order[: -(-len(x) // 2)]], x[order[-(-len(x) // 2) :]]) if len(x) > 1 else (x, x)
    centres, children, leaf, members = [own.mean(axis=0) if len(own) else np.zeros(x.shape[1])], [[]], [-1], [np.arange(len(own))]
    node = leaves = 0
    while node < len(members):
        rows = members[node]
        choice = _split(own[rows], rng) if len(rows) > leaf_size else None
        if choice is None:
            leaf[node] = leaves
            leaves += 1
        else:
            for i in np.unique(choice).tolist():
                children[node].append(len(members))
                members.append(rows[choice == i])
                centres.append(own[members[-1]].mean(axis=0))
                children.append([])
                leaf.append(-1)
        node += 1
    tree = Tree(np.array(centres), children, leaf)
    tree.visits = _calibrate(tree, held_out, neighbours, recall, rng)
    return tree


def _calibrate(tree: Tree, x: np.ndarray, neighbours: int, recall: float, rng: np.random.Generator) -> int:
    """Visits, of leaves that hold rows, after which ``recall`` of the rows' own nearest have been met; all for 1."""
    if len(x) < 2 or recall >= 1:
        return tree.leaves
    of = tree.assign(x)
    held = np.bincount(of, minlength=tree.leaves)
    ranks = []
    for q in rng.choice(len(x), min(CALIBRATION, len(x)), replace=False).tolist():
        score = x @ x[q]
        score[q] = -np.inf
        best = np.argsort(-score, kind="stable")[: min(neighbours, len(x) - 1)]
        place = np.full(tree.leaves, tree.leaves, np.int64)
        met = [at for at in tree.order(x[q]) if held[at]]
        place[met] = np.arange(len(met))
        ranks.append(place[of[best]])
    ranks = np.sort(np.concatenate(ranks))
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)


def _leaves(tree: Tree, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.assign(_matrix(batch.column(0), size)).astype(np.int32))], [*batch.schema.names, "leaf"])

    return run


def _visits(tree: Tree, size: int, held: np.ndarray, cell_of: np.ndarray, least: int):
    """Each query once for each cell that it visits, with its leaves there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares, rows = (tree.centres**2).sum(axis=1), held.tolist()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                row, cells, leaves = [], [], []
                q = _matrix(part.column(2), size)
                near = squares - 2 * (q @ tree.centres.T)
                for k in range(len(q)):
                    visited = np.array(tree.visited(q[k], rows, least, near[k]), np.int32)
                    where = cell_of[visited]
                    for cell in np.unique(where).tolist():
                        row.append(k)
                        cells.append(cell)
                        leaves.append(visited[where == cell])
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in part.columns), pa.array(cells, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))], [*part.schema.names, "cell", "leaves"])

    return run


def best_of(q: np.ndarray, rough: np.ndarray, vectors: np.ndarray, ids: list[list[int]], neighbours: int) -> tuple[list[int], list[float]]:
    """The nearest ids to q by exact score, ties to smaller ids, each id once with its best; ids: of each row.

    rough: the product of q with each row up to rounding, -inf for rows that are not visited.
    """
    take, met = neighbours, int(np.count_nonzero(rough > -np.inf))
    while True:
        least = np.partition(rough, len(rough) - take)[len(rough) - take] if take < met else -np.inf
        at = np.flatnonzero(rough >= least - 1e-9 * max(1.0, abs(least))) if take < met else np.flatnonzero(rough > -np.inf)
        exact = (vectors[at] * q).sum(axis=1)
        found = sorted((-score, i) for score, k in zip(exact.tolist(), at.tolist(), strict=True) for i in ids[k])
        best: dict[int, float] = {}
        for score, i in found:
            best.setdefault(i, -score)
        if len(best) >= neighbours or len(at) == met:
            names = list(best)[:neighbours]
            return names, [best[i] for i in names]
        take *= 4  # ids that stand for several vectors


def _grouped(leaves: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Each leaf that is visited, with the places of the queries that visit it."""
    of = np.concatenate(leaves)
    query = np.repeat(np.arange(len(leaves)), [len(own) for own in leaves])
    order = np.argsort(of, kind="stable")
    of, query = of[order], query[order]
    starts = np.flatnonzero(np.diff(of, prepend=-1)).tolist()
    for lo, hi in zip(starts, [*starts[1:], len(of)], strict=True):
        yield int(of[lo]), query[lo:hi]


def _products(q: np.ndarray, leaves: list[np.ndarray], x: np.ndarray, bounds: np.ndarray, below: dict[int, tuple[Tree, np.ndarray, np.ndarray]], least: int) -> np.ndarray:
    """Products of queries with the rows of the leaves that each visits, -inf elsewhere: one matrix product a leaf.

    In leaves that are trees each query goes on to leaves further down, which are taken in the same way.
    """
    out = np.full((len(q), len(x)), -np.inf)
    for leaf, asking in _grouped(leaves):
        if leaf not in below:
            out[asking, bounds[leaf] : bounds[leaf + 1]] = q[asking] @ x[bounds[leaf] : bounds[leaf + 1]].T
            continue
        tree, order, starts = below[leaf]
        held = np.diff(starts).tolist()
        for at, further in _grouped([np.array(tree.visited(q[k], held, least), np.int64) for k in asking.tolist()]):
            rows, own = order[starts[at] : starts[at + 1]], asking[further]
            out[np.ix_(own, rows)] = q[own] @ x[rows].T
    return out


def _subtree(x: np.ndarray, at: int, neighbours: int, recall: float) -> tuple[Tree, np.ndarray, np.ndarray]:
    tree = fit_tree(x, neighbours=neighbours, recall=recall, leaf_size=LEAF_ROWS // 2)
    of = tree.assign(x)
    return tree, np.argsort(of, kind="stable") + at, np.concatenate(([0], np.cumsum(np.bincount(of, minlength=tree.leaves))))


def _cell(size: int, leaves: int, neighbours: int, recall: float, subtree: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        asked, names, scores = [], [], []
        if vectors.num_rows and queries.num_rows:
            leaf = vectors.column("leaf").to_numpy()
            order = np.argsort(leaf, kind="stable")
            x = _matrix(vectors.column("vector"), size)[order]
            ids = vectors.column("ids").take(pa.array(order)).to_pylist()
            bounds = np.searchsorted(leaf[order], np.arange(leaves + 1))
            large = np.flatnonzero(np.diff(bounds) >= subtree).tolist()
            below = {k: _subtree(x[bounds[k] : bounds[k + 1]], int(bounds[k]), neighbours, recall) for k in large}
            keys, asking = queries.column("query").to_pylist(), _matrix(queries.column("asking"), size)
            lists = queries.column("leaves").combine_chunks()
            wanted = np.split(lists.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(lists).to_numpy())[:-1])
            block = max(1, BLOCK // len(x))
            for lo in range(0, len(keys), block):
                q = asking[lo : lo + block]
                rough = _products(q, wanted[lo : lo + block], x, bounds, below, neighbours)
                for k in range(len(q)):
                    best, score = best_of(q[k], rough[k], x, ids, neighbours)
                    asked += [keys[lo + k]] * len(best)
                    names += best
                    scores += score
        pair = pa.struct([("a", pa.int64()), ("b", pa.int64())])
        return pa.table({"query": pa.array(asked, pair), "vec_id": pa.array(names, pa.int64()), "score": pa.array(scores, pa.float64())})

    return run


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector and its size of the rows that take part."""
    value = lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf"))
    whole = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", value) & F.exists("embedding", lambda v: v != 0)
    return vectors.filter(whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.size("embedding").alias("size"))


@only_result
def nearest_neighbours(vectors: DataFrame, is_query, *, neighbours: int = 20, recall: float = 0.95, sample: int = SAMPLE, subtree: int = SUBTREE) -> DataFrame:
    """Each query's nearest other vectors by inner product in double precision.

    vectors: vec_id and embedding (other columns are ignored); is_query: a condition on vec_id. Returns query_id,
    rank (from 1), vec_id and score, nearest first, ties to the smaller vec_id; fewer than ``neighbours`` only if
    there are fewer candidates. ``recall`` is what calibration aims at on the sample's half that was not fitted.

    Rows take no part if the id is null, or the vector is null, empty, zero, or holds a null or non-finite
    component, or has another length than the commonest. Of repeated ids as queries the least vector asks; as
    candidates, an id is listed once with its best score. No usable vectors give an empty result. Equal vectors
    are recognised by 128 bits of hashes among queries, by their components in the index.
    """
    spark = vectors.sparkSession
    usable = _usable(vectors)
    common = usable.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return empty
    dims, listed = common["size"], neighbours + 1  # an answer may have to leave out the query itself
    usable = usable.filter(F.col("size") == dims).select("vec_id", "vector").distinct()
    hashed = usable.withColumn("place", F.xxhash64("vector"))
    rank = F.row_number().over(Window.partitionBy("place", "vector").orderBy("vec_id"))
    index = hashed.withColumn("nth", rank).filter(F.col("nth") <= listed).groupBy("place", "vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    index = materialise(index.select("vector", "ids", "place"), "distinct")
    taken = smallest(index, "place", min(sample, SAMPLE_BYTES // (8 * dims))).select("vector").toArrow()  # bounded
    leaf_size = max(LEAST, LEAF_ROWS * taken.num_rows // 2 // max(1, index.count()))
    tree = fit_tree(_matrix(taken.column(0), dims), neighbours=neighbours, recall=recall, leaf_size=leaf_size)
    index = materialise(index.select("vector", "ids").mapInArrow(lean(_leaves(tree, dims)), "vector array<double>, ids array<long>, leaf int"), "index")
    counted = {r["leaf"]: r["n"] for r in index.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row for each leaf
    held = np.array([counted.get(i, 0) for i in range(tree.leaves)], np.int64)
    cell_of = tree.cells(held, CELL)
    asking = usable.filter(is_query).groupBy("vec_id").agg(F.min("vector").alias("asking"))
    asking = materialise(asking.select("vec_id", F.struct(F.xxhash64("asking").alias("a"), F.xxhash64(F.lit(1), "asking").alias("b")).alias("query"), "asking"), "asking")
    distinct = asking.groupBy("query").agg(F.count("*").alias("askers"), F.first("asking").alias("asking"))
    pair = "struct<a: long, b: long>"
    # a query is few bytes and long walks, so that its bytes say nothing of how many tasks are right
    n, cores = asking.count(), spark.sparkContext.defaultParallelism
    distinct = distinct.repartition(max(1, min(-(-n // WALKS), max(4 * cores, -(-n // CELL)))), "query")
    asked = materialise(distinct.mapInArrow(lean(_visits(tree, dims, held, cell_of, listed)), f"query {pair}, askers long, asking array<double>, cell int, leaves array<int>"), "queries")
    wanted = asked.groupBy("cell").agg(F.count("*").alias("n")).collect()  # a row for each cell
    if not wanted:
        return empty
    rows_of = np.bincount(cell_of, held, int(cell_of.max()) + 1).astype(np.int64)
    grid = spark.createDataFrame([(r["cell"], -(-int(rows_of[r["cell"]]) // CELL), -(-r["n"] // CELL)) for r in wanted], "cell int, rows int, columns int")
    cells = spark.createDataFrame(pa.table({"leaf": pa.array(range(tree.leaves), pa.int32()), "cell": pa.array(cell_of)}))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(F.broadcast(cells), "leaf").join(F.broadcast(grid), "cell")  # at most a row for each leaf
    left = left.select("cell", "leaf", "ids", "vector", F.pmod(F.xxhash64("vector"), F.col("rows")).cast("int").alias("row"), each("columns").alias("column"))
    right = asked.join(F.broadcast(grid), "cell").select("cell", "query", "asking", "leaves", each("rows").alias("row"), F.pmod(F.xxhash64("query"), F.col("columns")).cast("int").alias("column"))
    by = ["cell", "row", "column"]
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_cell(dims, tree.leaves, listed, recall, subtree), f"query {pair}, vec_id long, score double")
    once = met.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = once.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= listed)
    best = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("found"))
    answers = asking.select(F.col("vec_id").alias("query_id"), "query").join(best, "query")
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, neighbours)
    return answers.select("query_id", F.posexplode(others).alias("at", "f")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "f.vec_id", "f.score")
