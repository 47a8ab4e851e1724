"""Words of whole texts as numpy arrays: no Python object per word.

Two definitions of a word are used, both after lower-casing A-Z:

* ``SPACED``: runs of anything but ASCII white space (``[^\\x20\\x09-\\x0D]+``);
* ``ALNUM``: runs of ASCII letters and digits and of any non-ASCII character
  (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``).

Either is a 256-entry byte table that maps separators to a space. UTF-8 bytes above 0x7F are kept, so
working on bytes gives the same words as working on characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is a batch of its own.
BATCH_BYTES = 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACED = bytes(32 if b == 32 or 9 <= b <= 13 else _LOWER[b] for b in range(256))
ALNUM = bytes(_LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[32] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Odd multipliers for the places of a shingle.
PLACES = _RNG.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_POWERS = np.cumprod(np.full(256, _BASE, np.uint64))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(max(n, 2 * len(_POWERS)), _BASE, np.uint64))
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in new memory."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Words:
    """Words of several texts: byte range in ``data``, index of the text, 64-bit hash."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    n_docs: int

    def bounds(self) -> np.ndarray:
        """Where each text's words begin, and the end of the last."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]]


def split_words(texts: list[bytes | None], table: bytes, detach: bool = False) -> Words:
    """Words of the texts; with detach, one ASCII mark that ends a word after a letter or digit is its own word."""
    texts = [t or b"" for t in texts]
    data = (b"\n".join(texts) + b"\n").translate(table)
    b = np.frombuffer(data, np.uint8)
    inside = np.concatenate(([False], b != 32))
    start = np.flatnonzero(inside[1:] & ~inside[:-1])
    end = np.flatnonzero(inside[:-1] & ~inside[1:])
    if detach:
        cut = _ends_in_mark(b, start, end)
        at = np.flatnonzero(cut) + 1
        start, end = np.insert(start, at, end[cut] - 1), np.insert(end - cut, at, end[cut])
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(data, start, end, doc, _hashes(b, start), len(texts))


_MARK = np.isin(np.arange(256), list(b".,;:!?"))
_PLAIN = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))


def _ends_in_mark(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    long = end - start >= 3
    last, before, lead = b[end - 1], b[np.maximum(end - 2, 0)], b[np.maximum(end - 3, 0)]
    letter = _PLAIN[before] | ((lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))  # Latin-1 letters
    return long & _MARK[last] & letter


def _hashes(b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hashes of the runs that begin at start; in blocks of words, so that long texts stay cheap."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(start, start[at] + BATCH_BYTES)))
        lo, hi = start[at], start[to] if to < len(start) else len(b)
        own = start[at:to] - lo
        sizes = np.diff(np.append(own, hi - lo))
        place = np.arange(hi - lo) - np.repeat(own, sizes)
        values = _BYTE[b[lo:hi]]
        values *= _powers(int(sizes.max()))[place]
        out[at:to] = np.add.reduceat(values, own)
        at = to
    return mix(out)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of k words within one text."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    total = words.hash[:n] * PLACES[0]
    for j in range(1, k):
        total += words.hash[j : n + j] * PLACES[j]
    first = np.flatnonzero(words.doc[:n] == words.doc[k - 1 :])
    return first, mix(total[first])


def sequence_hash(hashes: np.ndarray) -> int:
    """What shingles() gives for exactly these words."""
    return int(mix(np.sum(hashes * PLACES[: len(hashes)], keepdims=True, dtype=np.uint64))[0])


def text_batches(batch: pa.RecordBatch, column: str = "text", limit: int = BATCH_BYTES) -> Iterator[tuple[int, list[bytes | None]]]:
    """(first row, texts as UTF-8) of slices of about ``limit`` bytes: whole texts, never parts."""
    texts = batch.column(batch.schema.get_field_index(column))
    values = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
    sizes = np.asarray(pa.compute.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    group = np.cumsum(sizes) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
        if hi > lo:
            yield int(lo), values.slice(lo, hi - lo).to_pylist()


import pyarrow.compute  # noqa: E402,F401  (pa.compute is a submodule)
