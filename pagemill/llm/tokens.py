"""Word and punctuation runs of whole texts as 64-bit hashes, computed on code points."""

from __future__ import annotations

import functools

import numpy as np

from pagemill.llm._common import code_points, mix
from pagemill.llm.pretokens import LETTER, NUMBER, SPACE, _classes
from pagemill.llm.shingles import span_hashes

WORD, PUNCTUATION, GAP = 1, 2, 0


@functools.lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    kinds = _classes()
    own = np.full(len(kinds), PUNCTUATION, np.uint8)
    own[(kinds == LETTER) | (kinds == NUMBER)] = WORD
    own[kinds == SPACE] = GAP
    return own, mix(np.arange(1, len(kinds) + 1, dtype=np.uint64))


def runs(texts: list[str], kinds: tuple[int, ...] = (WORD, PUNCTUATION)) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of letters and numbers, or of other signs, in lower case; and each text's first run (one more
    at the end). White space only separates."""
    points, ends = code_points([t.lower() + "\n" for t in texts])
    table, values = _tables()
    kind = table[points]
    edge = np.flatnonzero(np.diff(kind, prepend=np.uint8(GAP)))
    if not len(edge):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    ends_of = np.append(edge[1:], len(points))
    mine = np.isin(kind[edge], kinds)
    start, end = edge[mine], ends_of[mine]
    return span_hashes(points, values, start, end), np.searchsorted(start, ends)
