"""Vectorised tokenising and hashing of whole Arrow string columns.

Everything here works on the UTF-8 bytes of a batch at once with numpy, so a
batch of texts costs a handful of array passes instead of a Python loop over
words.  Words are maximal runs of bytes that are not separators; every
separator used by the operators is ASCII, so byte runs equal character runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_MASK = (1 << 64) - 1
_POWERS: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _byte_codes(seed: int) -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP) + np.uint64(seed))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown by doubling and kept."""
    have = _POWERS.get(str(base))
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        _POWERS[str(base)] = have
    return have[:n]


#: Lower-cases A-Z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words split at space, tab, line feed, vertical tab, form feed, return.
BLANK_WORDS = np.ones(256, bool)
BLANK_WORDS[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words made of digits, lower-case letters and anything beyond ASCII.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array and n+1 offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a batch: byte spans, texts they belong to, and 64-bit hashes.

    start, end: byte spans into ``data`` (lower-cased); doc: index of the text;
    first: n+1 offsets of each text's words; hash: a hash of each word's bytes.
    """

    def __init__(self, column, kind: np.ndarray = BLANK_WORDS, hashed: bool = True, seed: int = 0):
        raw, offsets = utf8(column)
        self.data, self.offsets, self.n = LOWER[raw], offsets, len(offsets) - 1
        size = len(self.data)
        inside = np.zeros(size + 1, bool)
        inside[:size] = kind[self.data]
        starts = inside[:size].copy()
        cut = offsets[(offsets > 0) & (offsets < size)]
        starts[1:] &= ~inside[: size - 1] if size else inside[:0]
        starts[cut] = inside[cut]  # a text's first byte starts a word whatever stands before it
        ends = inside[:size] & ~inside[1:]
        ends[cut - 1] = inside[cut - 1]
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets).astype(np.int64)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n), self.counts)
        if hashed:
            self.hash = span_hashes(self.data, self.start, self.end, seed)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of data[start:end] for every span, equal for equal bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = len(data)
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(_byte_codes(seed)[data] * _powers(_STEP, size), out=total[1:])
    back = _powers(pow(_STEP, -1, 1 << 64), size)
    length = (end - start).astype(np.uint64)
    return mix64((total[end] - total[start]) * back[start] + length * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of every run of ``width`` words; a shorter non-empty text is one run."""
    n, h = len(words.hash), words.hash
    rolled = np.zeros(n, np.uint64)
    for k in range(min(width, n)):
        part = h[k:] * np.uint64(pow(_STEP, 2 * k + 1, 1 << 64))
        rolled[: n - k] += mix64(part + np.uint64(k + 1))
    place = np.arange(n) - words.first[words.doc]
    whole = place + width <= words.counts[words.doc]
    short = (words.counts > 0) & (words.counts < width)
    hashes, docs = mix64(rolled[whole]), words.doc[whole]
    if short.any():
        extra, at = [], np.flatnonzero(short)
        for i in at:
            value = np.uint64(words.counts[i])
            for x in h[words.first[i] : words.first[i + 1]]:
                value = mix64(np.array([value], np.uint64) * np.uint64(_STEP) ^ x)[0]
            extra.append(value)
        hashes, docs = np.concatenate([hashes, np.array(extra, np.uint64)]), np.concatenate([docs, at])
        order = np.argsort(docs, kind="stable")
        hashes, docs = hashes[order], docs[order]
    return hashes, docs


def distinct_by_doc(hashes: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, one after another, and n+1 offsets."""
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    hashes, docs = hashes[keep], docs[keep]
    return hashes, np.searchsorted(docs, np.arange(n + 1))


def slices(column: pa.Array, most: int = 1 << 19, rows: int = 1 << 20):
    """(first row, Array) pieces of a string column with about ``most`` bytes and at most ``rows`` rows each; one long text is one piece."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    _, offsets = utf8(column)
    n, at = len(column), 0
    while at < n:
        end = min(at + rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1))
        yield at, column.slice(at, end - at)
        at = end
