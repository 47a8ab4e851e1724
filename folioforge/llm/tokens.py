"""Token ids of whole texts, one tokenizer call for each distinct run of non-space characters."""

from __future__ import annotations

import os

import numpy as np

from .words import SPACED, split_words

#: Distinct runs remembered by a worker; beyond that it forgets those that only one batch had.
REMEMBERED = 600_000
#: Runs learned last, which are looked up apart until they are so many.
RECENT = 100_000

_KEPT_CASE = bytes(32 if b == 32 or 9 <= b <= 13 else b for b in range(256))


class RunEncoder:
    """Ids of texts under a tokenizer that folds case and whose pre-tokens never cross white space.

    Such a tokenizer drops white space and treats what lies between on its own, so a text's ids are those of
    its runs, one after the other; a mark after a letter is a pre-token by itself. Runs are found and compared
    as arrays; the tokenizer sees each new run once. The tokenizer file is opened by the worker that uses it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.keys = self.recent = np.empty(0, np.uint64)  # hashes, sorted; and each one's number:
        self.of_key = self.of_recent = np.empty(0, np.int64)
        self.flat = np.empty(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.batches = np.zeros(1 << 14, np.int32)  # that had the run
        self.n = self.used = 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of runs by their hashes (sorted); -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        for keys, numbers in ((self.keys, self.of_key), (self.recent, self.of_recent)):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = keys[at] == hashes
                out[hit] = numbers[at[hit]]
        return out

    def _learn(self, hashes: np.ndarray, runs: list[str]) -> None:
        ids: list[int] = []
        ends = []
        for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False):
            ids += e.ids
            ends.append(len(ids))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.n + len(runs) + 1 > len(self.starts):
            self.starts, self.batches = np.concatenate([self.starts, np.zeros_like(self.starts)]), np.concatenate([self.batches, np.zeros_like(self.batches)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[self.n + 1 : self.n + 1 + len(runs)] = np.array(ends) + self.used
        self.batches[self.n : self.n + len(runs)] = 0
        self.recent, self.of_recent = _merged(self.recent, self.of_recent, hashes, np.arange(self.n, self.n + len(runs)))
        if len(self.recent) > RECENT:
            self.keys, self.of_key = _merged(self.keys, self.of_key, self.recent, self.of_recent)
            self.recent, self.of_recent = self.recent[:0], self.of_recent[:0]
        self.used += len(ids)
        self.n += len(runs)

    def _keep_common(self) -> None:
        """Forget runs that few batches had: one, or as few as leaves half of the room free."""
        keys, numbers = _merged(self.keys, self.of_key, self.recent, self.of_recent)
        least = 2
        while (kept := self.batches[numbers] >= least).sum() > REMEMBERED // 2:
            least *= 2
        keys, numbers = keys[kept], numbers[kept]
        begin, sizes = self.starts[numbers], self.starts[numbers + 1] - self.starts[numbers]
        ends = np.cumsum(sizes)
        flat = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - sizes), sizes)]
        self._forget()
        self.n, self.used = len(keys), len(flat)
        self.flat = np.concatenate([flat, self.flat])
        self.starts, self.batches = np.concatenate([[0], ends, self.starts]), np.concatenate([np.ones(self.n, np.int32), np.zeros(len(self.starts) + 1, np.int32)])
        self.keys, self.of_key = keys, np.arange(self.n)

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin and the end)."""
        # added tokens such as "<|name|>" are case-sensitive
        plain = not any(b"<|" in t for t in texts if t)
        words = split_words(texts, SPACED if plain else _KEPT_CASE, detach=plain)
        if self.n > REMEMBERED:
            self._keep_common()
        distinct, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        at = self._find(distinct)
        if len(new := np.flatnonzero(at < 0)):
            for lo in range(0, len(new), 4096):
                part = new[lo : lo + 4096]
                at[part] = np.arange(self.n, self.n + len(part))
                self._learn(distinct[part], [words.word(i).decode() for i in first[part].tolist()])
        self.batches[at] += 1
        at = at[inverse]
        sizes = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(sizes)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - (ends - sizes), sizes)
        return self.flat[take], np.concatenate(([0], ends))[words.bounds()]


def _merged(a: np.ndarray, of_a: np.ndarray, b: np.ndarray, of_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted arrays as one, each with what belongs to it."""
    both = np.concatenate([a, b])
    order = np.argsort(both, kind="stable")
    return both[order], np.concatenate([of_a, of_b])[order]


_OPEN: dict[str, RunEncoder] = {}


def encoder(path: str) -> RunEncoder:
    """This worker's encoder for a tokenizer file: what it has learned serves all tasks of the worker."""
    if path not in _OPEN:
        _OPEN[path] = RunEncoder(path)
    return _OPEN[path]
