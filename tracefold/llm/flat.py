"""Word hashing over the raw UTF-8 buffer of an Arrow string column.

A batch is never turned into Python strings: words are runs of "word" bytes
found with a 256-entry class table, and each word's 64-bit polynomial hash is a
difference of two prefix sums.  Work is done on slices of about a megabyte, so
memory stays bounded whatever the batch or the longest text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def lower_ascii() -> np.ndarray:
    """Byte map that lower-cases A-Z and keeps the rest."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def word_bytes(separators: list[tuple[int, int]]) -> np.ndarray:
    """Boolean table of the bytes that are in words, given closed ranges that are not."""
    t = np.ones(256, dtype=bool)
    for lo, hi in separators:
        t[lo : hi + 1] = False
    return t


#: words are runs outside these bytes: white space only / all ASCII but letters and digits
SPACE = [(0x20, 0x20), (0x09, 0x0D)]
NON_ALNUM = [(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)]


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, SLICE + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; nulls read as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


@dataclass
class Words:
    """The words of documents ``first`` to ``first + len(offsets) - 2`` of a batch."""

    first: int
    hashes: np.ndarray  # uint64, one per word
    offsets: np.ndarray  # word offsets by document
    starts: np.ndarray  # byte positions in the batch's buffer
    ends: np.ndarray


def _spans(raw: np.ndarray, doc_starts: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = is_word[raw]
    start = w.copy()
    start[1:] &= ~w[:-1]
    start[doc_starts] = w[doc_starts]
    end = w.copy()
    end[:-1] &= ~w[1:]
    last = doc_starts[doc_starts > 0] - 1
    end[last] = w[last]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def _hash(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(low)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(low.astype(np.uint64) * _power("p", _BASE, n), out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * _power("i", _INV, n)[starts])


def _cut(raw: np.ndarray, is_word: np.ndarray) -> list[tuple[int, int]]:
    """Slices of one long text that end between words."""
    out, at = [], 0
    while at < len(raw):
        to = min(at + SLICE, len(raw))
        while to < len(raw):
            gap = np.flatnonzero(~is_word[raw[at:to]])
            if len(gap):
                to = at + int(gap[-1]) + 1
                break
            to = min(to + SLICE, len(raw))
        out.append((at, to))
        at = to
    return out


def words(column: pa.Array, is_word: np.ndarray, lower: np.ndarray) -> Iterator[Words]:
    """Hash every word of every text; yields runs of whole documents in order.

    Words are runs of bytes whose image under ``lower`` is in ``is_word``.
    """
    is_word = is_word[lower]
    offsets, data = string_buffer(column)
    n = len(offsets) - 1
    doc = 0
    while doc < n:
        to = max(doc + 1, int(np.searchsorted(offsets, offsets[doc] + SLICE, "right")) - 1)
        to = min(to, n)
        lo, hi = int(offsets[doc]), int(offsets[to])
        raw = data[lo:hi]
        heads = offsets[doc:to] - lo
        if hi - lo > SLICE and to == doc + 1:
            parts = []
            for a, b in _cut(raw, is_word):
                s, e = _spans(raw[a:b], np.zeros(1, np.int64), is_word)
                parts.append((_hash(lower[raw[a:b]], s, e), s + a, e + a))
            h, s, e = (np.concatenate(x) for x in zip(*parts, strict=True))
        elif hi > lo:
            s, e = _spans(raw, heads[heads < hi - lo], is_word)
            h = _hash(lower[raw], s, e)
        else:
            h, s, e = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield Words(doc, h, np.searchsorted(s, np.append(heads, hi - lo)), s + lo, e + lo)
        doc = to


def grams(h: np.ndarray, k: int, salt: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words (len(h) - k + 1 of them)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n = len(h) - k + 1
    out = np.full(n, salt, np.uint64)
    c = np.uint64(_BASE)
    for i in range(k):
        out = (out ^ h[i : i + n]) * c
        out ^= out >> np.uint64(29)
    return mix(out)
