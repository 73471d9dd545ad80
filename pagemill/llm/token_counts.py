"""Token counts under a unigram model, by dynamic programming over distinct pre-tokens in sorted order.

Words that begin with the same SHARED bytes meet in one bucket of the shuffle, whatever block they come from, and all of a
bucket's distinct words make one trie, in which each prefix is scored once. Only prefixes shorter than SHARED bytes, of
which there are few, are scored in several buckets.

The model takes the tokens of a byte-level vocabulary; a token of rank r has the score -log((r + 1) * H), with H the
harmonic number of the vocabulary's size (Zipf's law: the ranks are all the file states of the frequencies). A
pre-token's count is the number of tokens in its best-scored segmentation; among equal scores the fewest tokens win.
"""

from __future__ import annotations

import base64
import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.llm._common import id_text
from pagemill.llm.bpe import read_ranks
from pagemill.llm.pretokens import lookup

BLOCK_BYTES = 16 << 20
SHARED = 4


@functools.lru_cache(2)
def _vocabulary(ranks: bytes) -> tuple[dict, int]:
    """The vocabulary as nested dicts from a token's last byte to its first (a token's score stands under -1), and the
    length of its longest token."""
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    norm = math.log(sum(1 / (r + 1) for r in range(len(table))))
    root: dict = {}
    for token, rank in table.items():
        node = root
        for byte in reversed(token):
            node = node.setdefault(byte, {})
        node[-1] = -math.log(rank + 1) - norm
    return root, max(map(len, table))


def common(a: bytes, b: bytes) -> int:
    """The length of the beginning that two words share."""
    low, high = 0, min(len(a), len(b))
    step = 8
    while low < high and a[low : low + step] == b[low : low + step]:
        low, step = min(high, low + step), 2 * step
    high = min(high, low + step)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _saved_depths(shared: list[int]) -> list[list[int]]:
    """shared[i] is what sorted word i shares with the one before. For each word the depths, ascending, at which a later
    word leaves its path and which no word between them walks again."""
    saves: list[set] = [set() for _ in shared]
    path: list[int] = []
    for i, depth in enumerate(shared):
        while path and shared[path[-1]] >= depth:
            path.pop()
        if path:
            saves[path[-1]].add(depth)
        path.append(i)
    return [sorted(s) for s in saves]


def trie_counts(words: list[bytes], vocabulary: tuple[dict, int]) -> list[int]:
    """Counts of the words. Sorted words are a trie in depth-first order: each prefix that they share is scored once.

    A prefix's score (and count) is the best of those of the prefixes before it that a token leads to it from, the longest
    token's length back at most. So only the last scores are held, and a copy of them for each depth of the present word's
    path at which a later word leaves it: memory does not grow with a word's length. Every vocabulary here has all 256
    bytes as tokens, so that each prefix has a segmentation.
    """
    root, longest = vocabulary
    out: list[int] = [0] * len(words)
    order = sorted(range(len(words)), key=words.__getitem__)
    shared = [0, *(common(words[a], words[b]) for a, b in zip(order, order[1:]))]
    held: list[tuple[int, list]] = [(0, [(0.0, 0)])]
    for at, start, saves in zip(order, shared, _saved_depths(shared[: len(order)])):
        word = words[at]
        while held[-1][0] > start:
            held.pop()
        best = list(held[-1][1])
        base = start + 1 - len(best)  # the depth of best[0]
        depths = iter([*saves, -1])
        save = next(depths)
        for d in range(start + 1, len(word) + 1):
            node, top = root, None
            for i in range(d - 1, max(d - 1 - longest, -1), -1):
                node = node.get(word[i])
                if node is None:
                    break
                score = node.get(-1)
                if score is not None:
                    before = best[i - base]
                    found = (before[0] + score, before[1] - 1)
                    if top is None or found > top:
                        top = found
            if top is None:
                raise ValueError(f"no token covers byte {word[d - 1]}")
            best.append(top)
            if d == save:
                held.append((d, best[-longest:]))
                save = next(depths)
            if len(best) > 8 * longest + 4096:
                base += len(best) - longest
                del best[:-longest]
        out[at] = -best[-1][1]
    return out


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) for each row of docs, over whole texts.

    Distinct pre-tokens are shuffled once, counted through the trie, and joined back. docs must be a stored table. A
    null text counts as empty (0 tokens); repeated rows give a row each; an empty table gives none; columns other than
    the two named are not read. A pre-token of any length (a line of signs without a blank is one) is scored in memory that
    does not grow with it, but for itself.
    """
    ranks = read_ranks(vocabulary)

    def answer():
        vocabulary = _vocabulary(ranks)
        return lambda words: [n.to_bytes(4, "little") for n in trie_counts(words, vocabulary)]

    def finish():
        def rows(ids, codes, answers):
            each = np.frombuffer(b"".join(answers), "<u4").astype(np.int64)
            return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_pretokens": pa.array([len(c) for c in codes], pa.int64()), "n_tokens": pa.array([int(each[c].sum()) for c in codes], pa.int64())})

        return rows

    return lookup(id_text(docs, id_col, text_col), answer, finish, "doc_id bigint, n_pretokens bigint, n_tokens bigint", BLOCK_BYTES, SHARED)
