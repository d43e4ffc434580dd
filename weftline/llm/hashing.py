"""Vectorised hashing of words and characters, for use inside tasks.

Texts arrive as Arrow string arrays.  They are worked through in short runs, so a
task's memory follows its largest text, never its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RUN_BYTES = 700_000
_M = np.uint64(0x9E3779B97F4A7C15 | 5)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SEED = np.random.default_rng(20240229)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX1
    h ^= h >> np.uint64(33)
    h *= _MIX2
    h ^= h >> np.uint64(33)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS["up"]) < n:
        inverse = np.uint64(pow(int(_M), -1, 2**64))
        for name, base in (("up", _M), ("down", inverse)):
            steps = np.full(max(n, RUN_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end] (bytes)."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def runs(col: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets) of runs of whole texts; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = memoryview(col.buffers()[2] or b"")
    first = 0
    while first < len(col):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + RUN_BYTES, "right")) - 1)
        yield first, end, bytes(data[offsets[first] : offsets[end]]), offsets[first : end + 1] - offsets[first]
        first = end
    pa.default_memory_pool().release_unused()


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words (runs without ASCII white space, inside one text) start and end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = ~_SPACE[data]
    first, last = inner.copy(), inner.copy()
    first[1:] &= ~inner[:-1]
    last[:-1] &= ~inner[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] |= inner[edge]
    last[edge - 1] |= inner[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the index of its first word (n + 1 long)."""
    data = np.frombuffer(raw, np.uint8)
    starts, ends = word_spans(data, offsets)
    return spans_hash(data, starts, ends), np.searchsorted(starts, offsets)


_GRAM = _SEED.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles and their text's index; shorter texts give one.

    A text with fewer than n words, but at least one, gives its whole sequence.
    """
    counts = np.diff(bounds)
    grams = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        grams += hashes[k : k + len(grams)] * _GRAM[k]
    owner = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(bounds[1:], counts) - np.arange(len(hashes))
    whole = left[: len(grams)] >= n
    short = np.flatnonzero((counts > 0) & (counts < n))
    extra = np.zeros(len(short), np.uint64)
    for k in range(n - 1):
        has = counts[short] > k
        extra[has] += hashes[bounds[short[has]] + k] * _GRAM[k]
    extra += counts[short].astype(np.uint64) * _GRAM[15]
    return mix(np.concatenate([grams[whole], extra])), np.concatenate([owner[: len(grams)][whole], short])


def distinct_sets(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each owner's distinct values, ascending, back to back, and n + 1 bounds."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    if len(values):
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(n + 1))
