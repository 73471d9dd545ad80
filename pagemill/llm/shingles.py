"""Words and word shingles of whole texts as 64-bit hashes, computed on byte arrays."""

from __future__ import annotations

import functools

import numpy as np

from pagemill.llm._common import mix

#: Odd, so that it has an inverse modulo 2**64; any odd number would do.
BASE = 0x9E3779B97F4A7C15
#: White space between words: U+0020 and U+0009 to U+000D.
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


@functools.lru_cache(1)
def _byte_values() -> np.ndarray:
    """A 64-bit value for every byte; A-Z have those of a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64))
    values[65:91] = values[97:123]
    return values


@functools.lru_cache(1)
def _white() -> np.ndarray:
    white = np.zeros(256, bool)
    white[list(WHITE)] = True
    return white


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(21, n.bit_length())
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b & 0xFFFFFFFFFFFFFFFF, np.uint64)])) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def span_hashes(points: np.ndarray, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of points[start:end] for each span; values has a 64-bit value for every symbol."""
    forth, back = _powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(values[points] * forth[: len(points)], out=sums[1:])
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts' words in order: hash, start and end as bytes of the texts joined by a blank; and the number of the
    first word of each text (one more at the end)."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    edge = np.flatnonzero(np.diff(_white()[data], prepend=True))
    start, end = edge[::2], edge[1::2]
    begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return span_hashes(data, _byte_values(), start, end), start, end, np.searchsorted(start, begins)


def shingled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words (fewer: none)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, size):
        out *= np.uint64(BASE)
        out += hashes[j : n + j]
    return mix(out + np.uint64(size))


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words has none."""
    hashes, _, _, first = words(texts)
    every = shingled(hashes, size)
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(every[a : b - size + 1]))
        else:
            out.append(shingled(hashes[a:b], b - a)[:1] if b > a else np.zeros(0, np.uint64))
    return out
