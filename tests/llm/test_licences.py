import math
import random
import re
from collections import Counter

from folioforge.llm.licences import TEMPLATES, Scanner, scan_licences
from folioforge.llm.queries import QUERIES
from folioforge.llm.words import ALNUM, split_words
from tests.conftest import TABLES

from .conftest import ODD

PHRASES = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    w = words(text)
    places = [(k, label) for label, p in PHRASES.items() for k in range(len(w)) if w[k : k + len(p)] == p]
    at = [k for k, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def windows(text, templates, threshold):
    """(template, first word) -> containment of every window that reaches the threshold, by trying each."""
    w, out = words(text), {}
    for i, (_, t, *_) in enumerate(templates):
        own = words(t)
        kinds = set(own)
        held = Counter(x for x in w[: len(own)] if x in kinds)
        for at in range(max(1, len(w) - len(own) + 1)):
            if at:
                if (gone := w[at - 1]) in kinds:
                    held[gone] -= 1
                    held += Counter()
                if (new := w[at + len(own) - 1]) in kinds:
                    held[new] += 1
            if len(held) / len(kinds) >= threshold - 1e-9:
                out[i, at] = len(held) / len(kinds)
    return out


def named(text, templates, threshold):
    """label -> best containment of its blocks that count, by looking at every run of windows and every pair of runs."""
    w, found = words(text), windows(text, templates, threshold)
    kinds = [set(words(t[1])) for t in templates]
    need = [math.ceil(threshold * len(k) - 1e-9) for k in kinds]
    runs = []
    for i, at in sorted(found):
        size = min(len(words(templates[i][1])), len(w))
        told = set(words(templates[i][2] if len(templates[i]) > 2 else "")) <= set(w[at : at + size])
        if not runs or runs[-1][0] != i or runs[-1][1] != at - 1:
            runs.append([i, at, at, at + size, False, 0.0])
        run = runs[-1]
        run[1], run[3] = at, at + size
        if told and not run[4]:
            run[4], run[5] = True, 0.0
        if told == run[4]:
            run[5] = max(run[5], found[i, at])
    out = {}
    for i, _, first, last, told, best in runs:
        held = round(best * len(kinds[i]))
        beaten = any(r[4] and templates[r[0]][0] != templates[i][0] and len(kinds[i] & kinds[r[0]]) >= need[i] and r[2] < last and r[3] > first and round(r[5] * len(kinds[r[0]])) > held for r in runs)
        if told and not beaten:
            out[templates[i][0]] = max(best, out.get(templates[i][0], 0.0))
    return out


def spread(blocks):
    """The same from a row's blocks: every window of each run."""
    out = set()
    for b in blocks:
        size = len(words(TEMPLATES[b["template"]][1]))
        assert b["label"] == TEMPLATES[b["template"]][0] and b["last"] - b["first"] + 1 <= size + b["windows"] - 1
        own = {(b["template"], b["first"] + k) for k in range(b["windows"])}
        assert not own & out and (b["template"], b["best"]) in own
        out |= own
    return out


def test_odd_rows(frame):
    rows = scan_licences(frame(ODD)).collect()
    assert sorted(((r.doc_id is None, r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, ",".join(r.base_labels)) for r in rows) == sorted(((i is None, i), *base(t)) for i, t in ODD)
    assert scan_licences(frame([])).collect() == []


def planted(rng):
    own = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(60))]
    for _ in range(rng.randrange(3)):
        cut = words(rng.choice(TEMPLATES)[1])
        for _ in range(rng.randrange(3)):
            cut[rng.randrange(len(cut))] = rng.choice(["zz", "the", "license"])
        own[rng.randrange(len(own) + 1) : 0] = cut[rng.randrange(2) * len(cut) // 8 :]
    return " ".join(own)


def test_every_block_is_found(frame):
    rng = random.Random(5)
    texts = {k: planted(rng) for k in range(120)} | {500: "", 501: "Licensed under", 502: "by the license " * 400, 503: TEMPLATES[1][1] * 3}
    rows = scan_licences(frame(list(texts.items()))).collect()
    assert sum(bool(r.blocks) for r in rows) > 60
    for r in rows:
        expected = windows(texts[r.doc_id], TEMPLATES, 0.8)
        assert spread(r.blocks) == expected.keys()
        assert all(math.isclose(b["containment"], expected[b["template"], b["best"]]) for b in r.blocks)
        told = named(texts[r.doc_id], TEMPLATES, 0.8)
        assert math.isclose(r.score, 1.0 if r.n_base else max(told.values(), default=0.0))
        assert set(r.labels) == {*r.base_labels, *told} and r.labels == sorted(r.labels)


def test_long_texts_of_template_words_are_linear():
    scanner = Scanner(TEMPLATES, (), {}, 0.8)
    assert scanner.blocks(split_words([b"software " * 200_000], ALNUM)) == []


def test_related_notices(frame):
    rows = {r.doc_id: (",".join(r.labels), r.closest) for r in scan_licences(frame([(1, "x y Licensed under CC BY-NC 4.0. z"), (2, "a Licensed under CC BY 4.0"), (3, "licensed under the apache license, version 2.0"), (4, "no notice at all")])).collect()}
    assert rows[1] == ("cc-by-nc", "cc-by-nc") and rows[2] == ("cc-by", "cc-by") and rows[3] == ("apache", "apache") and rows[4] == ("", None)


def test_no_template_gives_another_licence(frame):
    """Every template's own text, alone and inside other words, against every other label."""
    rows = [(2 * k, t[1]) for k, t in enumerate(TEMPLATES)] + [(2 * k + 1, f"some words before {t[1]} and after it") for k, t in enumerate(TEMPLATES)]
    for r in scan_licences(frame(rows)).collect():
        own = TEMPLATES[r.doc_id // 2][0]
        assert set(r.labels) - set(r.base_labels) <= {own} and own in r.labels and r.closest == own, (own, r.labels)


def test_licences_that_are_not_named(frame):
    rows = ["This tool is released under the BSD license.", "Licensed under the Mozilla License, version 2.0", "Licensed under CC BY 4.0.", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-ND 4.0.", "Released under the license."]
    found = {r.doc_id: list(r.labels) for r in scan_licences(frame(list(enumerate(rows)))).collect()}
    assert found == {0: [], 1: [], 2: ["cc-by"], 3: ["cc-by-nc"], 4: ["cc-by-nd"], 5: []}


def test_ties_go_to_the_longer_template_then_the_first_label(frame):
    pair = (("b", "one two three"), ("a", "three two one"), ("c", "one two three four"))
    rows = {r.doc_id: r.closest for r in scan_licences(frame([(1, "one two three"), (2, "one two three four")]), templates=pair).collect()}
    assert rows == {1: "a", 2: "c"}


def test_query_equals_brute_force(spark, documents):
    rows = QUERIES["op6_license_scans"](spark, TABLES).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows} == {i: base(t) for i, t in documents.items()}
    for r in rows:
        expected = named(documents[r.doc_id], TEMPLATES, 0.8)
        labels = set(expected)
        assert set(filter(None, r.labels.split(","))) == labels | set(filter(None, r.base_labels.split(",")))
        assert math.isclose(r.score, 1.0 if r.n_base else max(expected.values(), default=0.0)) and (r.closest in labels or not labels and r.closest is None)
