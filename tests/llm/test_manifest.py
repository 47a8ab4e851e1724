import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from folioforge.llm.manifest import climb, merkle_manifest, siblings
from folioforge.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, node string, grp string, rank string, part string, size string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def coded(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def up(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def steps(levels, at, fanout):
    out = []
    for level in levels[:-1]:
        run = level[at // fanout * fanout :][:fanout]
        out.append((run[: at % fanout], run[at % fanout + 1 :]))
        at //= fanout
    return out


def brute(rows, altered=lambda i, t: t, fanout=3):
    """Every row as the tree of its source and the tree of sources have it, folded step by step."""
    by = {}
    for i, source, lang, n, text in rows:
        by.setdefault(source, []).append((i is not None, i or 0, coded(i, source, lang, n, text), coded(i, source, lang, n, altered(i, text)), i))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: up([r[2] for r in sorted(by[s])], fanout) for s in sources}
    top = up([trees[s][-1][0] for s in sources], fanout)
    out = []
    for k, s in enumerate(sources):
        for at, (_, _, leaf, changed, i) in enumerate(sorted(by[s])):
            path, node = steps(trees[s], at, fanout) + steps(top, k, fanout), changed
            for left, right in path:
                node = sha("".join([*left, node, *right]))
            proof = sha("".join(x for left, right in path for x in left + right))
            out.append((str(i), leaf, trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out)


def found(frame):
    return sorted((str(r.doc_id), *r[1:]) for r in frame.collect())


def make(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, *["x"] * 5) for r in rows], SCHEMA).repartition(partitions)


def test_levels_and_siblings():
    leaves = "".join(sha(str(k)) for k in range(8)).encode()
    levels = climb(leaves, None)
    assert [len(x) // 64 for x in levels] == [8, 3, 1]
    assert levels[1][-64:].decode() == sha(sha("6") + sha("7"))
    assert siblings(leaves, 7) == (sha("6").encode(), b"") and siblings(leaves, 4) == (sha("3").encode(), sha("5").encode())
    assert [len(x) // 64 for x in climb(leaves[:64], 2)] == [1, 1, 1]  # part of a larger tree
    assert climb(leaves[:64], None) == [leaves[:64]]


@pytest.mark.parametrize(("depth", "fanout"), [(1, 3), (2, 3), (6, 3), (1, 2), (3, 5)])
def test_equals_brute_force(spark, depth, fanout):
    rng = random.Random(depth)
    rows = [(k, rng.choice(["web", "web", "web", "books", "", "é", "Z"]), rng.choice(["en", None]), k * 3, rng.choice(["a\nb", "c", "\n", "", None])) for k in range(160)]
    rows += [(k, None, "en", None, "x\ny") for k in range(40, 44)] + [(5, "web", "en", 1, "again"), (5, "web", "en", 1, "again"), (None, "web", None, None, "two\nlines"), (None, None, None, None, None)]
    rows += [(1000, "alone", "de", 2, "é" * 40_000 + "\n"), (1001, "pair", "de", 2, "\n"), (1002, "pair", "de", 2, "q")]
    rng.shuffle(rows)
    text = F.when(F.col("doc_id") % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    got = found(merkle_manifest(make(spark, rows), text, depth=depth, fanout=fanout))
    assert got == brute(rows, lambda i, t: t.replace("\n", "") if i is not None and i % 2 == 0 and t is not None else t, fanout)
    assert {r[-1] for r in got} == {True, False}


def test_untouched_rows_verify(spark):
    rows = [(k, "s", "en", 1, str(k)) for k in range(50)]
    assert all(r[-1] for r in found(merkle_manifest(make(spark, rows), depth=1)))


def test_small_tables(spark):
    assert merkle_manifest(make(spark, [])).collect() == []
    (only,) = found(merkle_manifest(make(spark, [(7, "s", None, None, None)])))
    assert only == ("7", coded(7, "s", None, None, None), only[1], only[1], sha(""), only[1], True)


def test_query_equals_its_sql(same):
    same(QUERIES["op11_merkle_manifest"], ORACLES["op11_merkle_manifest"])


def test_tampering_is_by_checksum(spark, documents):
    rows = {r.doc_id: r.verified for r in QUERIES["op11_merkle_manifest"](spark, "/root/testdata/sf0.001").collect()}
    assert rows == {i: not (zlib.crc32(str(i).encode()) % 2 == 0 and "\n" in t) for i, t in documents.items()}
