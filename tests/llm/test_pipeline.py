import functools
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioforge.llm import pii
from folioforge.llm.tokens import RunEncoder
from folioforge.llm.toxicity import score_toxicity, train_toxicity
from tests.conftest import TABLES

from .conftest import ODD


@pytest.fixture(scope="module", autouse=True)
def short_training():
    """Stages as they are, but for a tagger that has hardly learned: what it adds is tested in test_pii.py."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(corpus_pipeline, "train_pii", functools.partial(pii.train_pii, how=pii.Tagger(examples=256, epochs=2)))
        yield


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def one_of_each(rows):
    """(key, text) rows in order -> those that stay: the first of each group, copies of a row once."""
    kept, groups = [], []
    sets = [grams(t) for _, t in rows]
    for k, own in enumerate(sets):
        if not own:
            kept.append(k)
            continue
        near = [g for g in groups if any(100 * len(own & sets[m]) >= 80 * len(own | sets[m]) for m in g)]
        groups = [g for g in groups if g not in near] + [sum(near, []) + [k]]
    return sorted(kept + [min(g) for g in groups])


def benchmark_words(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit = set()
    for own in items:
        size = min(13, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(w) - size + 1):
            if size and tuple(w[i : i + size]) in windows:
                hit.update(range(i, i + size))
    return len(hit), len(w)


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.materialise(stage(spark, out[-1], TABLES), name))
    return out


def ids(frame):
    return {r.doc_id for r in frame.select("doc_id").collect()}


def test_each_stage_equals_brute_force(spark, stages):
    docs, clean, single, apart, masked, packed = stages
    assert all(s.columns == docs.columns for s in (clean, single, apart, masked))
    labels = spark.read.parquet(f"{TABLES}/labels.parquet").filter(~F.col("doc_id").isin([i for i in ids(docs) if zlib.crc32(str(i).encode()) % 4 == 2]))
    scores = {r.doc_id: r.score for r in score_toxicity(docs, train_toxicity(docs, labels)).collect()}
    assert ids(clean) == {i for i, s in scores.items() if s < 0.3}
    rows = sorted((r.doc_id, r.text) for r in clean.collect())
    assert ids(single) == {rows[k][0] for k in one_of_each(rows)} and len(ids(single)) < len(rows)
    items = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r.text)) for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").collect()]
    hits = {r.doc_id: benchmark_words(r.text, items) for r in single.collect()}
    assert ids(apart) == {i for i, (hit, n) in hits.items() if not hit or 20 * hit < n} and len(ids(apart)) < len(hits)
    before = {r.doc_id: r.text for r in apart.collect()}
    model = corpus_pipeline.train_pii(apart)
    for r in masked.collect():
        spans = pii.all_spans(pii.base_spans(before[r.doc_id]), pii.tagged_spans(model, [before[r.doc_id]])[0])
        assert r.text == pii.mask(before[r.doc_id], spans) and r.n_chars == len(r.text) and pii.base_spans(r.text) == []
    import public_tokenizers

    encoder = RunEncoder(public_tokenizers.path("word_bpe_49k.json"))
    whole = {r.doc_id: encoder.tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0] for r in masked.collect()}
    pieces = {}
    for r in packed.collect():
        pieces.setdefault(r.doc_id, {})[r.piece] = r
        assert r.length <= 2048
    assert pieces.keys() == whole.keys()
    for i, own in pieces.items():
        assert b"".join(own[k].ids for k in range(len(own))) == b"".join(x.to_bytes(4, "little") for x in whole[i])
    for own in _sequences(packed).values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def _sequences(packed):
    out = {}
    for r in packed.collect():
        out.setdefault(r.sequence_id, []).append((r.offset, r.length))
    return out


def test_run_gives_the_last_stage(spark, stages):
    rows = corpus_pipeline.run(spark, TABLES)
    assert rows.count() == stages[5].count() and rows.columns == stages[5].columns
    total = rows.agg(F.sum("length")).first()[0]
    assert total == stages[5].agg(F.sum("length")).first()[0]


#: By stage, how many of the odd rows stay: two "one" texts are one row twice and another id's.
LEFT = {"toxicity": 10, "ngram_jaccard_join": 8, "benchmark_decontamination": 10, "pii": 10, "best_fit_packing": None}


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_odd_rows(spark, frame, stage):
    clashing = {c: F.lit("x") for c in ("__key", "__toxicity", "key", "Toxicity", "toxicity_", "record", "component_id", "mask")}
    docs = frame(ODD).withColumns({"n_chars": F.length("text").cast("long")} | clashing)
    rows = stage[1](spark, docs, TABLES).collect()
    if LEFT[stage[0]]:
        assert len(rows) == LEFT[stage[0]] and {r.doc_id for r in rows} >= {1, 2, 3, 4, 6, 7, 8, None} and sorted(rows[0].asDict()) == sorted(docs.columns)
    else:
        assert sum(r.piece == 0 for r in rows) == len(ODD)
    assert stage[1](spark, docs.limit(0), TABLES).collect() == []


def test_rows_are_judged_by_their_own_text(spark, frame):
    """Repeated and null ids: only rows that are near duplicates go, and null ids give way to others."""
    long = " ".join(f"w{k}" for k in range(40))
    docs = frame([(1, long), (1, "other text"), (1, "other text"), (None, long + " more"), (None, "alone here"), (None, "alone here"), (2, long)])
    rows = corpus_pipeline.ngram_jaccard_join(spark, docs, TABLES).collect()
    assert sorted((str(r.doc_id), r.text) for r in rows) == [("1", "other text"), ("1", long), ("None", "alone here")]


def test_without_labels_and_benchmark(spark, frame, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame([(1, "some text"), (2, "more of it")])
    for stage in (corpus_pipeline.toxicity, corpus_pipeline.benchmark_decontamination):
        assert sorted(r.doc_id for r in stage(spark, docs, str(tmp_path)).collect()) == [1, 2]
