import random

import numpy as np
import pytest

from folioforge.operators import names, sketches
from folioforge.operators.catalogue_views import keyword_search
from folioforge.sources import text_index
from folioforge.sources.text_index import TextIndex

LETTERS = "abcAB é éÉßſKkİiıςσΣ.x\n"


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(3)
    rows = [(d, p, "".join(rng.choice(LETTERS) for _ in range(rng.randrange(60)))) for d in range(60) for p in range(1, 4)]
    rows += [(70, 1, None), (70, 2, ""), (71, 1, "Straße ΟΔΟΣ straSSe οδοσ İzmir"), (72, 1, "a needle in it " * 3), (72, 2, "NEEDLE"), (None, 1, "needle too")]
    return spark.createDataFrame(rows, "doc_id long, page_num int, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def index(pages, spark, tmp_path_factory):
    return TextIndex.build(pages, str(tmp_path_factory.mktemp("index") / "i"), pages_per_block=10)


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_searches_equal_a_scan(pages, index):
    rng = random.Random(5)
    words = ["needle", "Straße", "οδος", "ΟΔΟΣ", "izmir", "İzmir", "strasse", "k", "aB", "zzz", "needle in it a", "\n", "..."]
    words += ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, 6))) for _ in range(25)]
    for w in words:
        for case in (False, True):
            if w.strip():
                assert rows(index.search(w, case)) == rows(keyword_search(pages, w, case)), (w, case)


def test_a_search_reads_few_files(pages, index):
    whole = index.pages().inputFiles()
    near = index.pages_with("needle")
    assert near.count() == 3 and len({f for f in near.inputFiles() if "/pages/" in f}) <= 3 < len(whole)
    assert index.pages_with("qqq").count() == 0 and index.pages_with("ab").count() == pages.count()


def test_folders_of_pages_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "SHELVES", 3)
    monkeypatch.setattr(text_index, "CHARACTERS", 50)
    made = spark.range(300).selectExpr("id as doc_id", "1 as page_num", "concat('page \U0001f600', id % 7, '\u0000', id) as text")
    index = text_index.TextIndex.build(made, str(tmp_path / "i"), pages_per_block=10)
    assert len(list((tmp_path / "i" / "pages").glob("*=*"))) == 3
    assert rows(index.search("\U0001f6003\u00002")) == rows(keyword_search(made, "\U0001f6003\u00002")) != []
    assert {r.doc_id for r in index.pages_with("page").collect()} == set(range(300))


def test_lists_hold_every_trigram_once():
    texts = ["abcabc", "", "ab", "\U0001f600\x00é", "abc"]
    numbers = {}
    for row in text_index._lists(np.array([0, 0, 0, 1, 1]), np.array([1, 2, 5, 1, 2]), [t.encode() for t in texts]).to_pylist():
        assert row["pages"] == len(row["steps"])
        numbers.setdefault((row["gram"], row["block"]), []).extend(np.cumsum(row["steps"]).tolist())
    assert numbers == {("abc", 0): [1], ("bca", 0): [1], ("cab", 0): [1], ("\U0001f600\x00é", 1): [1], ("abc", 1): [2]}


def test_lookup_of_short_and_long_queries(spark):
    rng = random.Random(8)
    people = [("".join(rng.choice("abno ") for _ in range(rng.randrange(3, 12))).strip() or "x", k) for k in range(300)]
    records = spark.createDataFrame([(f"k{k}", n.title(), [f"v{k}"], k) for n, k in people], "canonical_key string, display_name string, variants array<string>, total_count int")
    asked = ["a", "nb", "abn", "o a", "zzz", " ", "banan", "v7", "n.", "AN"]
    found = names.lookup(records, spark.createDataFrame([(q,) for q in asked], "query string")).collect()
    got = {(r.query, r.canonical_key) for r in found if r.stage == 3}
    assert got == {(q, f"k{k}") for q in asked if q.strip() and q != "v7" for n, k in people if q.strip().lower() in n.title().lower()} and len(got) == sum(r.stage == 3 for r in found)
    assert [(r.query, r.canonical_key) for r in found if r.stage == 2] == [("v7", "k7")]


def test_merged_sketches_keep_their_bound(spark):
    rng = random.Random(1)
    values = [(k % 3, k % 50, float(rng.choice([rng.gauss(0, 9), 5.0]))) for k in range(40_000)] + [(1, 1, None), (2, 2, float("nan")), (9, 9, None)]
    frame = spark.createDataFrame(values, "run int, doc int, x double").repartition(7)
    merged = sketches.merge(sketches.sketch(frame, ["run", "doc"], "x"), ["run"])
    errors = sketches.rank_errors(frame, sketches.quantiles(merged, (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)), ["run"], "x").collect()
    assert len(errors) == 21 and all(r.rank_error <= sketches.RANK_ERROR for r in errors) and {r.n for r in errors} == {13334, 13333}
    own = sorted(x for run, _, x in values if run == 1 and x is not None)
    bins = {r.bin: r["values"] for r in sketches.histogram(merged, (-100.0, 0.0, 5.0, 100.0)).filter("run = 1").collect()}
    counted = [sum(lo < x <= hi for x in own) for lo, hi in ((-100, 0), (0, 5), (5, 100))]
    assert all(abs(bins[k] - n) <= 2 * sketches.RANK_ERROR * len(own) for k, n in enumerate(counted))


def test_small_groups_are_exact(spark):
    frame = spark.createDataFrame([("a", float(k)) for k in range(101)], "g string, x double")
    found = sketches.quantiles(sketches.sketch(frame, ["g"], "x"), (0.0, 0.5, 1.0)).collect()
    assert [(r.share, r.value) for r in found] == [(0.0, 0.0), (0.5, 50.0), (1.0, 100.0)]
    assert sketches.sketch(frame.limit(0), ["g"], "x").collect() == []
