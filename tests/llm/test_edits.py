import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from folioforge.llm.edits import Counter, CountTree, count_tokens, masking_edits
from folioforge.llm.pii import KINDS, base_spans
from folioforge.llm.queries import QUERIES
from tests.conftest import TABLES

from .conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def counter():
    return Counter(PATH)


def full(counter, text):
    return len(counter.encoding.encode_ordinary(text))


def test_random_edits_equal_encoding_all_again(counter):
    rng = random.Random(5)
    kinds = ["a", "B", "1", " ", "  ", "\n", "'", "r", "e", "s", "é", "!", "word ", " the", "\t"]
    make = lambda n: "".join(rng.choice(kinds) for _ in range(n))
    for _ in range(1500):
        text = make(rng.choice([0, 3, 20, 400]))
        tree = CountTree(counter, text)
        for _ in range(4):
            start = rng.randrange(len(text) + 1)
            end = rng.randint(start, min(len(text), start + rng.choice([0, 2, 10, 200])))
            new = make(rng.choice([0, 1, 4, 100]))
            tree.edit(start, end, new)
            text = text[:start] + new + text[end:]
            assert (tree.text, tree.total, tree.chars) == (text, full(counter, text), len(text))


def test_only_the_touched_region_is_encoded(counter):
    tree = CountTree(counter, "some plain words " * 5000)
    tree.edit(40_000, 40_003, "other")
    assert tree.encoded < 10


def depth(node):
    """Of the tree, and whether the sums of every node hold."""
    if node is None:
        return 0
    below = [n for n in (node.left, node.right) if n]
    assert node.chars == len(node.text) + sum(n.chars for n in below) and node.tokens == sum(t for _, t in node.pieces) + sum(n.tokens for n in below)
    assert node.size == 1 + sum(n.size for n in below) and len(node.text) == sum(c for c, _ in node.pieces)
    return 1 + max(depth(node.left), depth(node.right))


def test_edits_across_runs_touch_a_path(counter):
    """Edits that cut, join and add runs, in a long text: work per edit stays near the logarithm of the text."""
    rng = random.Random(4)
    text = " ".join(rng.choice(["alpha", "beta", "gamma's", "42", "\n\n", "é"]) for _ in range(60_000))
    tree = CountTree(counter, text)
    n, worst = 0, 0
    for _ in range(300):
        start = rng.randrange(len(text))
        end, new = min(len(text), start + rng.choice([0, 5, 900])), " new words" * rng.choice([0, 1, 200])
        touched, encoded = tree.touched, tree.encoded
        tree.edit(start, end, new)
        text = text[:start] + new + text[end:]
        worst = max(worst, tree.touched - touched)
        assert tree.encoded - encoded <= 2 * len(new.split()) + 12
        n += 1
    assert (tree.text, tree.total) == (text, full(counter, text))
    assert worst < 250 and depth(tree.root) < 60 and tree.root.size > 1500


def test_many_edits_keep_balance(counter):
    tree, text = CountTree(counter, ""), ""
    for k in range(1500):
        new = f"word{k} and more words to fill a run, "
        tree.edit(len(text), len(text), new)
        text += new
    assert tree.total == full(counter, text) and depth(tree.root) < 60


def test_edits_out_of_range_are_errors(counter):
    with pytest.raises(ValueError):
        CountTree(counter, "abc").edit(2, 9, "")


def masked(text):
    out, at = [], 0
    for start, kind, end in base_spans(text):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def expected(counter, texts):
    return sorted(((i is None, i), full(counter, t or ""), full(counter, masked(t or ""))) for i, t in texts)


def found(rows):
    return sorted(((r.doc_id is None, r.doc_id), r.n_tokens, r.n_tokens_after) for r in rows)


def test_odd_rows(frame, counter):
    assert found(count_tokens(masking_edits(frame(ODD)), PATH).collect()) == expected(counter, ODD)
    assert count_tokens(masking_edits(frame([])), PATH).collect() == []


def test_null_edits_and_replacements(spark):
    rows = spark.createDataFrame([(1, "a b c", None), (2, "a b c", [(2, 3, None)])], "doc_id long, text string, edits array<struct<start: long, end: long, replacement: string>>")
    assert {r.doc_id: (r.n_edits, r.n_tokens, r.n_tokens_after) for r in count_tokens(rows, PATH).collect()} == {1: (0, 3, 3), 2: (1, 3, 3)}


def test_query(spark, documents, counter):
    rows = QUERIES["op10_token_counts"](spark, TABLES).collect()
    assert found(rows) == expected(counter, list(documents.items()))
    assert all(r.n_encoded_again <= 12 * r.n_edits for r in rows)


def test_masking_ignores_other_columns(frame):
    docs = frame([(1, "a@b.cc x")]).withColumn("edits", F.lit("mine"))
    rows = masking_edits(docs)
    assert rows.columns == ["doc_id", "text", "edits"] and [(e.start, e.end, e.replacement) for e in rows.first().edits] == [(0, 6, "[EMAIL]")]
