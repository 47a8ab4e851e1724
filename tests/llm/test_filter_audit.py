import itertools
import random
import re

import pytest

from folioforge.llm.filter_audit import audit_filters, failure_masks
from folioforge.llm.queries import ORACLES, QUERIES

from .conftest import ODD


def fails(rows):
    """(part, id, failed letters) of (id, source, text) rows, from the conditions as they are stated."""
    out = []
    for i, source, text in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        bad += "E" * any(j is not None and i is not None and j < i and (u or "") == t for j, _, u in rows)
        out.append((source or "", i, bad))
    return out


def brute(rows, good, toxic):
    """Every order applied filter by filter."""
    failed, out, over = fails(rows), {}, {}
    for part in {p for p, _, _ in failed}:
        own = [(i, bad) for p, i, bad in failed if p == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                redundant = sum(f in bad for _, bad in own) - len(gone)
                left = [d for d in left if f not in d[1]]
                over[part, f] = over.get((part, f), 0) + len(gone)
                out[part, order, step] = [len(left), len(gone), redundant, sum(bad == f for _, bad in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    return {k: (*v, over[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def corpus(rng, n):
    plain = " ".join(f"w{k}" for k in range(60))
    shared = [plain, "SHOUT " * 55, "short", "", None, plain + " 5%", "é" * 30]
    rows = [(k, rng.choice(["web", "web", "books", "", None]), rng.choice([*shared, plain, plain, f"{plain} {k}"])) for k in range(n)]
    rows += [(3, "web", plain), (3, "web", plain), (None, "web", plain), (None, "books", "nothing else"), (n + 1, "web", " \x0b\x0c\x1c word\u00a0word")]
    rng.shuffle(rows)
    return rows


def make(spark, rows, partitions):
    schema = "doc_id long, source string, text string, part string, mask string, key string, first string, mark string, range string"
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], schema).repartition(partitions)


@pytest.fixture
def ranges(spark):
    """Runs a test with so many ranges, so that groups of equal texts are cut by many boundaries."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def ordered(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("n", [1, 3, 40])
def test_masks_equal_brute_force(spark, ranges, n):
    ranges(n)
    rows = [(i, "s", t) for i, t in ODD] + corpus(random.Random(n), 150)
    found = failure_masks(make(spark, rows, 3)).collect()
    assert ordered((r.part, r.doc_id, "".join(f for b, f in enumerate("ABCDE") if r["mask"] >> b & 1)) for r in found) == ordered(fails(rows))


def test_colliding_fingerprints(spark, ranges, monkeypatch):
    """Different texts of one fingerprint, cut by boundaries, are told apart."""
    from pyspark.sql import functions as F

    ranges(7)
    monkeypatch.setattr(F, "xxhash64", lambda c: F.length(c).cast("long"))
    rows = [(k, "s", "abc"[k % 3] * 4) for k in range(90)] + [(200 + k, "s", f"t{k:03}") for k in range(30)]
    found = failure_masks(make(spark, rows, 3)).collect()
    assert {r.doc_id for r in found if r["mask"] & 16} == set(range(3, 90))


def test_all_orders_equal_brute_force(spark, ranges):
    ranges(5)
    rng = random.Random(1)
    rows = corpus(rng, 120)
    good, toxic = set(rng.sample(range(120), 40)), set(rng.sample(range(120), 30))
    labels = [(i, int(i in good), int(i in toxic), "x") for i in good | toxic | {7}] + [(i, 0, None, "x") for i in good] + [(None, 1, 1, "x"), (9999, 1, 1, "x")]
    found = audit_filters(make(spark, rows, 3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, part string")).collect()
    assert {tuple(r[:3]): tuple(r[3:]) for r in found} == brute(rows, good, toxic)
    assert len(found) == 600 * 3


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(make(spark, [], 1), labels).collect() == []
    (row,) = [r for r in audit_filters(make(spark, [(1, None, None)], 1), labels).collect() if r.filter_order == "BADCE" and r.step == 2]
    assert tuple(row) == ("", "BADCE", 2, 0, 1, 0, 1, 0, 0, 120)


def test_query_equals_its_sql(same):
    same(QUERIES["op12_filter_audit"], ORACLES["op12_filter_audit"])
