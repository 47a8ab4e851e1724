import random
import zlib
from collections import Counter, defaultdict

import pytest

from folioforge.llm.queries import QUERIES
from folioforge.llm.sharding import Rooms, best_fit_decreasing, pack_bins, shard_documents, write_shards
from tests.conftest import TABLES

from .conftest import ODD


def check(rows, texts, shards):
    assert sorted(((r.doc_id is None, r.doc_id), r["size"], r.text_crc32) for r in rows) == sorted(((i is None, i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    slots, of = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        of[r.text_crc32, r["size"]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    return of


def test_odd_rows(frame):
    of = check(shard_documents(frame(ODD), shards=3).collect(), ODD, 3)
    assert all(len(s) == 1 for key, s in of.items() if key[1] > 8)


def test_empty_table(frame):
    assert shard_documents(frame([])).collect() == []


def test_rooms_are_the_tightest():
    rng = random.Random(3)
    rooms, plain = Rooms(), []
    for k in range(3000):
        if rng.random() < 0.6:
            room = rng.randrange(500)
            rooms.add(room, k)
            plain.append((room, k))
        else:
            size = rng.randrange(520)
            best = min((p for p in plain if p[0] >= size), default=None)
            assert rooms.take(size) == best
            if best:
                plain.remove(best)


def plain_best_fit(sizes, capacity, most):
    """One item after the other into the tightest of all bins."""
    room, out = [], []
    for size in sorted(sizes, reverse=True):
        fits = [(r, k) for k, r in enumerate(room) if r >= size]
        if not fits:
            if len(room) == most or size > capacity:
                return None
            room.append(capacity)
            fits = [(capacity, len(room) - 1)]
        k = min(fits)[1]
        room[k] -= size
        out.append((size, k))
    return out


def spread(runs, lines):
    return [(size, which) for (size, _), line in zip(runs, lines, strict=True) for which, put in line for _ in range(put)]


@pytest.mark.parametrize("seed", range(8))
def test_runs_pack_as_single_items_do(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([3, 5, 8, 13, 40, 41, rng.randrange(1, 90)]) for _ in range(rng.randrange(1, 200))]
    runs = sorted(Counter(sizes).items(), reverse=True)
    for capacity in (40, 95, 200, sum(sizes) // 5 + 1, sum(sizes)):
        for most in (3, 7, 50):
            found, expected = best_fit_decreasing(runs, capacity, most), plain_best_fit(sizes, capacity, most)
            assert (found is None) == (expected is None)
            if found is not None:
                load = lambda items: sorted(Counter(k for _, k in items).values())
                assert sorted(s for s, _ in spread(runs, found)) == sorted(s for s, _ in expected)
                bins = lambda items: sorted(sorted(s for s, k in items if k == b) for b in {k for _, k in items})
                assert bins(spread(runs, found)) == bins(expected) and load(spread(runs, found)) == load(expected)


def loads(histogram, lines, bins):
    load, by_size = [0] * bins, defaultdict(list)
    for size, rank, which in lines:
        by_size[size].append((rank, which))
    assert by_size.keys() == histogram.keys()
    for size, own in by_size.items():
        own.sort()
        assert own[0][0] == 0
        for (rank, which), (following, _) in zip(own, [*own[1:], (histogram[size], None)]):
            assert following > rank
            load[which] += size * (following - rank)
    return load


@pytest.mark.parametrize("seed", range(5))
def test_bins_hold_everything_evenly(seed):
    rng = random.Random(seed)
    histogram = Counter(rng.randrange(1, 1000) for _ in range(3000))
    load = loads(histogram, pack_bins(histogram, 24), 24)
    total = sum(s * n for s, n in histogram.items())
    assert sum(load) == total and max(load) - min(load) <= 60 and max(load) <= -(-total // 24) + 2
    assert pack_bins({}, 3) == []


def test_large_groups_leave_the_rest_even():
    histogram = {10_000: 1, 3000: 1, 7: 500, 11: 300}
    load = loads(histogram, pack_bins(histogram, 5), 5)
    assert sorted(load)[-2:] == [3000, 10_000] and max(sorted(load)[:3]) - min(load) <= 11
    assert sorted(loads({50: 4}, pack_bins({50: 4}, 3), 3)) == [50, 50, 100]
    assert sorted(loads({9: 2}, pack_bins({9: 2}, 4), 4)) == [0, 0, 9, 9]


def test_one_group_larger_than_a_share(frame):
    texts = [(k, "big " * 500) for k in range(20)] + [(100 + k, f"small {k}") for k in range(60)]
    rows = shard_documents(frame(texts), shards=4).collect()
    check(rows, texts, 4)
    big = {r.shard for r in rows if r.doc_id < 20}
    assert len(big) == 1


def test_equal_sizes_are_dealt_by_rank(frame):
    """Many groups of one size: each has one place, and shards are as even as the size allows."""
    texts = [(k, f"text {k:04}") for k in range(400)]
    rows = shard_documents(frame(texts, partitions=7), shards=6).collect()
    check(rows, texts, 6)
    assert sorted(Counter(r.shard for r in rows).values()) == [66, 66, 67, 67, 67, 67]


def test_query_packs_as_brute_force(spark, documents):
    rows = QUERIES["op3_sharding"](spark, TABLES).collect()
    of = check(rows, list(documents.items()), 24)
    assert all(len(s) == 1 for s in of.values())
    groups = Counter()
    for t in documents.values():
        groups[t] += len(t.encode()) + 8
    load, own = Counter(), {}
    for r in rows:
        load[r.shard] += r["size"]
        own.setdefault(r.shard, set()).add(documents[r.doc_id])
    shared = {k: v for k, v in load.items() if len(own[k]) > 1}
    held = [groups[t] for k in shared for t in own[k]]
    alone = [groups[t] for k in load.keys() - shared.keys() for t in own[k]]
    assert all(a * (24 - k) >= sum(held) + sum(sorted(alone, reverse=True)[k:]) for k, a in enumerate(sorted(alone, reverse=True)))
    # no fuller than plain best fit needs, and no single group's move would make the others more even
    top, low = max(shared, key=shared.get), min(shared, key=shared.get)
    assert all(plain_best_fit(held, c, len(shared)) is None for c in range(-(-sum(held) // len(shared)), shared[top]))
    assert all(groups[t] >= shared[top] - shared[low] for t in own[top])


def test_written_shards_hold_every_row_once(spark, frame, tmp_path):
    docs = frame([*((k, f"text {k}") for k in range(30)), (3, "again"), (3, "again"), (None, "no id"), (None, None)])
    write_shards(docs, str(tmp_path / "s"), shards=3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 34 and set(docs.columns) | {"size", "slot"} <= set(back.columns)
    assert sorted((str(r.doc_id), str(r.text), r["class"]) for r in back.collect()) == sorted((str(r.doc_id), str(r.text), r["class"]) for r in docs.collect())
    slots = defaultdict(list)
    for r in back.collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
