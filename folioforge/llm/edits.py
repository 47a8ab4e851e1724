"""Edit-aware token counts.

A document keeps its text and the token counts of its pre-tokens in a segment tree: a node is a short run of
pre-tokens with its own characters, and knows the sums of characters and tokens of its subtree. An edit is found by
its character offset. The tree is split there, runs are taken off behind it one by one, and pre-tokens are cut
again from a little before the edit (the pattern looks two characters ahead) until a cut falls on an old one
behind it, from where everything is as before, since the pattern looks at nothing further back. Only these
pre-tokens are encoded; their runs are put in the place of the old ones and the sums on the way up are updated.
Splits and joins walk one path each, so an edit costs the logarithm of the text and what it touches, never the
text: the tree stays balanced by choosing roots at random in proportion to size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .memory import lean

#: Pre-tokens of a run when it is made.
RUN = 32
#: Characters before an edit whose pre-token may end otherwise because of it.
CONTEXT = 3
#: Pre-tokens whose counts a worker remembers.
REMEMBERED = 500_000


class Counter:
    """Token counts of pre-tokens, each encoded once."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, int] = {}

    def cut(self, text: str, start: int = 0) -> Iterator[str]:
        return (m[0] for m in self.pattern.finditer(text, start))

    def count(self, piece: str) -> int:
        found = self.known.get(piece)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[piece] = len(self.encoding.encode_ordinary(piece))
        return found


class Run:
    """A node: a run of pre-tokens as (characters, tokens), its text, and the sums of its subtree."""

    __slots__ = ("text", "pieces", "own", "chars", "tokens", "size", "left", "right")

    def __init__(self, text: str, pieces: list[tuple[int, int]]):
        self.text, self.pieces, self.own = text, pieces, sum(t for _, t in pieces)
        self.left: Run | None = None
        self.right: Run | None = None
        self.sum()

    def sum(self) -> Run:
        a, b = self.left, self.right
        self.chars = len(self.text) + (a.chars if a else 0) + (b.chars if b else 0)
        self.tokens = self.own + (a.tokens if a else 0) + (b.tokens if b else 0)
        self.size = 1 + (a.size if a else 0) + (b.size if b else 0)
        return self


def _build(runs: list[Run], lo: int, hi: int) -> Run | None:
    if lo >= hi:
        return None
    node = runs[(lo + hi) // 2]
    node.left, node.right = _build(runs, lo, (lo + hi) // 2), _build(runs, (lo + hi) // 2 + 1, hi)
    return node.sum()


class CountTree:
    """The pre-tokens of a text as a balanced tree of runs."""

    def __init__(self, counter: Counter, text: str):
        self.counter, self.encoded, self.touched = counter, 0, 0
        self._seed = 1
        runs = self._runs(text, [(len(p), counter.count(p)) for p in counter.cut(text)])
        self.root = _build(runs, 0, len(runs))

    @staticmethod
    def _runs(text: str, pieces: list[tuple[int, int]]) -> list[Run]:
        out, at = [], 0
        for i in range(0, len(pieces), RUN):
            own = pieces[i : i + RUN]
            size = sum(c for c, _ in own)
            out.append(Run(text[at : at + size], own))
            at += size
        return out

    @property
    def total(self) -> int:
        return self.root.tokens if self.root else 0

    @property
    def chars(self) -> int:
        return self.root.chars if self.root else 0

    def __iter__(self) -> Iterator[Run]:
        """The runs in order."""
        path, node = [], self.root
        while path or node:
            while node:
                path.append(node)
                node = node.left
            node = path.pop()
            yield node
            node = node.right

    @property
    def text(self) -> str:
        return "".join(run.text for run in self)

    def pretokens(self) -> int:
        return sum(len(run.pieces) for run in self)

    def _join(self, a: Run | None, b: Run | None) -> Run | None:
        """One tree of two: either root stays on top, in proportion to the sizes."""
        if a is None or b is None:
            return a or b
        self.touched += 1
        self._seed = self._seed * 6364136223846793005 + 1442695040888963407 & 0xFFFFFFFFFFFFFFFF
        if (self._seed >> 33) % (a.size + b.size) < a.size:
            a.right = self._join(a.right, b)
            return a.sum()
        b.left = self._join(a, b.left)
        return b.sum()

    def _split(self, node: Run | None, at: int) -> tuple[Run | None, Run | None]:
        """The runs that end at or before a character, and the others."""
        if node is None:
            return None, None
        self.touched += 1
        here = (node.left.chars if node.left else 0) + len(node.text)
        if here <= at:
            node.right, rest = self._split(node.right, at - here)
            return node.sum(), rest
        left, node.left = self._split(node.left, at)
        return left, node.sum()

    def _first(self, node: Run) -> tuple[Run, Run | None]:
        """The first run of a tree, and the tree without it."""
        self.touched += 1
        if node.left is None:
            rest, node.right = node.right, None
            return node.sum(), rest
        first, node.left = self._first(node.left)
        return first, node.sum()

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Put replacement in the place of characters start to end (exclusive)."""
        if not 0 <= start <= end <= self.chars:
            raise ValueError(f"no characters {start} to {end} in {self.chars}")
        before, after = self._split(self.root, max(0, start - CONTEXT))
        begin = before.chars if before else 0
        taken: list[Run] = []
        window, held = "", 0  # the old text from begin on as far as it is taken off the tree
        while after and begin + held < end + CONTEXT:
            run, after = self._first(after)
            taken.append(run)
            held += len(run.text)
        shift = len(replacement) - (end - start)
        while True:
            old = "".join(run.text for run in taken)
            window = old[: start - begin] + replacement + old[end - begin :]
            found = self._cut_again(window, taken, begin, start, end, shift, after is None)
            if found is not None:
                break
            for _ in range(len(taken)):  # as many again: a cut may be far off
                if after:
                    run, after = self._first(after)
                    taken.append(run)
        runs = self._runs(window, found)
        self.root = self._join(self._join(before, _build(runs, 0, len(runs))), after)

    def _cut_again(self, window: str, taken: list[Run], begin: int, start: int, end: int, shift: int, whole: bool) -> list[tuple[int, int]] | None:
        """The pre-tokens of a window that begins like an old one; None if its last cuts need the text behind it."""
        old = [piece for run in taken for piece in run.pieces]
        inside = at = 0  # pre-tokens before the edit that stay
        while inside < len(old) and begin + at + old[inside][0] <= start - CONTEXT:
            at += old[inside][0]
            inside += 1
        place, behind = inside, begin + at  # the next old pre-token and where it begins in the old text
        new, fresh = at, []
        for piece in self.counter.cut(window, at):
            while place < len(old) and (behind < end or behind + shift < begin + new):
                behind += old[place][0]
                place += 1
            if behind >= end and behind + shift == begin + new and (whole or place < len(old)):
                self.encoded += len(fresh)
                return old[:inside] + fresh + old[place:]
            if not whole and new + len(piece) + CONTEXT > len(window):
                return None
            fresh.append((len(piece), self.counter.count(piece)))
            new += len(piece)
        if not whole:
            return None
        self.encoded += len(fresh)
        return old[:inside] + fresh


_OPEN: dict[str, Counter] = {}


def _count(path: str, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _OPEN:
            _OPEN[path] = Counter(path)
        counter = _OPEN[path]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out: list[tuple] = []
                for text, edits in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    tree = CountTree(counter, text or "")
                    before, size, shift = tree.total, tree.pretokens(), 0
                    for e in sorted(edits or (), key=lambda e: (e["start"], e["end"])):
                        tree.edit(e["start"] + shift, e["end"] + shift, e["replacement"] or "")
                        shift += len(e["replacement"] or "") - (e["end"] - e["start"])
                    out.append((len(edits or ()), size, before, tree.total, tree.encoded))
                columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(id_type), *columns], ["doc_id", "n_edits", "n_pretokens", "n_tokens", "n_tokens_after", "n_encoded_again"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, edits: str = "edits") -> DataFrame:
    """Token counts of every row's whole text before and after its edits.

    docs: doc_id, text and an array ``edits`` of struct<start, end, replacement> in characters of the unedited
    text, not overlapping; other columns are ignored. Returns doc_id, n_edits, n_pretokens, n_tokens,
    n_tokens_after and n_encoded_again (pre-tokens that edits made it encode).

    Null and empty texts have no tokens. Null or empty edits change nothing; a null replacement is empty; one
    out of range raises an error. Repeated rows are counted each.
    """
    docs = docs.select("doc_id", "text", F.col(edits).alias("edits"))
    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, n_edits long, n_pretokens long, n_tokens long, n_tokens_after long, n_encoded_again long"
    return docs.mapInArrow(lean(_count(tokenizer_path, to_arrow_type(kind))), schema)


def masking_edits(docs: DataFrame) -> DataFrame:
    """docs with an ``edits`` array that masks what the patterns for personal data find."""
    from .pii import KINDS, base_spans

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("replacement", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                out, free = [], 0
                for start, k, end in base_spans(text or ""):
                    if start >= free:
                        out.append({"start": start, "end": end, "replacement": f"[{KINDS[k].upper()}]"})
                    free = max(free, end)
                rows.append(out)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*batch.schema.names, "edits"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, edits array<struct<start: long, end: long, replacement: string>>")
