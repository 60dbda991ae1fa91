"""Words of UTF-8 text as 64-bit hashes, found with numpy over whole Arrow buffers.

A word is a run of bytes other than ASCII white space. Its hash is a polynomial of its bytes
modulo 2**64, read off prefix sums, then mixed. Work goes in slices of bounded size that end
between documents, or inside a very long document between words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at once: what the temporary arrays need is some 60 times that.
SLICE = 1 << 20
_U = np.uint64
_STEP = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values after which every bit depends on every other."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE)
        for name, base in (("up", _STEP), ("down", pow(_STEP, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null has no bytes."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes, or a single row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _scan(data: np.ndarray, starts_at: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """First byte and hash of each word; no word goes over a place in ``starts_at``."""
    word = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[starts_at] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | cut[1:-1]
    last = word
    last[:-1] &= ~last[1:] | cut[1:-1]
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    up, down = _power(len(data))
    total = (_FOLD[data] if fold else data).astype(np.uint64)
    total += _U(1)
    total *= up[: len(data)]
    np.cumsum(total, out=total)
    h = total[b] - np.where(a > 0, total[a - 1], _U(0))
    h *= down[a]
    return a, mix(h ^ (b - a + 1).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def hashes(data: np.ndarray, offsets: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the documents between ``offsets``, and each document's range among them."""
    base, end = int(offsets[0]), int(offsets[-1])
    firsts, found, at = [], [], base
    while at < end:
        stop = min(end, at + 4 * SLICE)
        if stop < end:  # only inside a very long document
            space = np.flatnonzero(_SPACE[data[at:stop]])
            if len(space):
                stop = at + int(space[-1]) + 1
            else:
                more = np.flatnonzero(_SPACE[data[stop:end]])
                stop = stop + int(more[0]) + 1 if len(more) else end
        inner = offsets[(offsets >= at) & (offsets < stop)] - at
        a, h = _scan(data[at:stop], inner.astype(np.int64), fold)
        firsts.append(a + at)
        found.append(h)
        at = stop
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(found), np.searchsorted(np.concatenate(firsts), offsets)


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, by its first word."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total *= _U(_STEP)
        total += h[i : i + n]
    return mix(total + _U(size))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Each document's distinct shingles of ``size`` lower-cased words, sorted; a shorter text is one shingle."""
    for i, j in slices(offsets):
        h, at = hashes(data, offsets[i : j + 1], True)
        runs = windows(h, size)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield np.unique(runs[a : b - size + 1] if b - a >= size else windows(h[a:b], b - a) if b > a else runs[:0])
