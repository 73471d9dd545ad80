"""Benchmark decontamination by SimHash fingerprints of item-sized windows.

A document's words (runs of letters and numbers, lower case) are seen through windows of as many words as an item has; a
document of fewer words than the item is one window.
Windows and items have 256-bit SimHash fingerprints of their word shingles, weighted by how often they occur. The items'
fingerprints are held by BLOCKS blocks of 16 bits: two within RADIUS bits differ in at most RADIUS // BLOCKS bits of some
block, so that no pair within the radius is missed, and one in six of unlike ones remains. Two windows of similarity 0.8
differ in 38 bits on average, with a standard deviation below 6; beyond the radius lie some four in a million. Found pairs
are verified by the exact weighted Jaccard similarity of their shingles. Windows that share no shingle with any item have
the similarity 0 with all of them and are not fingerprinted.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm._common import chunks, mix, small_batches, texts_of
from pagemill.llm.shingles import shingled
from pagemill.llm.tokens import WORD, runs

BITS, BLOCKS, RADIUS = 256, 16, 63
#: So many pairs of windows and items are looked at at once.
PAIRS = 1 << 20
#: Items are taken in groups of so many bytes at most; each group is one pass over the documents.
GROUP_BYTES = 32 << 20
CHUNK = 1 << 20
#: Shingles of a document whose bits are held at once, besides a window's.
SLICE = 4096


def _bits(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the BITS bits of each shingle."""
    both = np.stack([mix(hashes + np.uint64(j * 0x5851F42D4C957F2D % (1 << 64))) for j in range(BITS // 64)], 1)
    return np.unpackbits(both.view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    """Blocks of 16 bits."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    x, y = Counter(a.tolist()), Counter(b.tolist())
    return sum((x & y).values()) / max(1, sum((x | y).values()))


_DISTANCE = np.array([i.bit_count() for i in range(1 << 16)], np.uint8)
_NEAR = _DISTANCE <= RADIUS // BLOCKS


def candidates(windows: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, item, distance) of all pairs of fingerprints within RADIUS, found by their blocks."""
    found = []
    step = max(1, PAIRS // len(prints))
    for low in range(0, len(windows), step):
        part = windows[low : low + step]
        some = np.zeros((len(part), len(prints)), bool)
        for b in range(BLOCKS):
            some |= _NEAR[part[:, b, None] ^ prints[None, :, b]]
        i, j = np.nonzero(some)
        distance = _DISTANCE[part[i] ^ prints[j]].sum(1, dtype=np.int32)
        near = distance <= RADIUS
        found.append((i[near] + low, j[near], distance[near]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 3


class Index:
    """Items by their number of words, with the fingerprints of each size in blocks."""

    def __init__(self, items: list[tuple[int | None, str]], words: int):
        hashes, first = runs([t for _, t in items], (WORD,))
        self.sizes: dict[int, list] = {}
        known: dict[int, list] = defaultdict(list)
        grouped = defaultdict(list)
        for (item, _), a, b in zip(items, first[:-1].tolist(), first[1:].tolist()):
            if b > a:
                w = min(words, b - a)
                own = shingled(hashes[a:b], w)
                known[w].append(own)
                grouped[b - a].append((item, own))
        self.known = {w: np.unique(np.concatenate(x)) for w, x in known.items()}
        for n, own in grouped.items():
            prints = np.concatenate([_fingerprints(_bits(s).sum(0, keepdims=True)) for _, s in own])
            self.sizes[n] = [min(words, n), own, prints]


def _search(own: np.ndarray, at: int, stretch: int, w: int, known: np.ndarray, index: Index, least: float, best: dict) -> None:
    """Puts into best what the windows show that begin within the first SLICE of some shingles; the first of them has the
    number `at`, and the stretch that they are cut from `stretch` shingles."""
    upto = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(_bits(own), 0, dtype=np.int32)])
    hits = np.concatenate([[0], np.cumsum(np.isin(own, known))])
    for n, (size, items, prints) in index.sizes.items():
        m = n - w + 1  # shingles of a window
        if size != w or stretch / m < least:  # no similarity can be higher
            continue
        m = min(m, stretch)  # a document of fewer words than the item is one window
        starts = np.flatnonzero(hits[m:] - hits[:-m] > 0)
        starts = starts[starts < SLICE]
        windows = _fingerprints(upto[starts + m] - upto[starts])
        for i, j, d in zip(*(x.tolist() for x in candidates(windows, prints))):
            first = int(starts[i])
            similarity = weighted_jaccard(own[first : first + m], items[j][1])
            key = (n, j)
            if similarity >= least and (key not in best or similarity > best[key][4]):
                best[key] = (items[j][0], at + first, m + w - 1, d, similarity)


def matches(hashes: np.ndarray, index: Index, least: float) -> list[tuple[int | None, int, int, int, float]]:
    """(item, first word, words, distance, similarity): for each item the best window of one document."""
    best: dict = {}
    for w, known in index.known.items():
        own = shingled(hashes, w)
        hit = np.flatnonzero(np.isin(own, known))
        if not len(hit):
            continue
        # stretches of words that windows with a hit can cover
        most = max(n for n, x in index.sizes.items() if x[0] == w)
        cuts = np.flatnonzero(np.diff(hit) > most) + 1
        for part in np.split(hit, cuts):
            low, high = max(0, part[0] - most + 1), min(len(own), part[-1] + most)
            for at in range(low, high, SLICE):
                _search(own[at : min(high, at + SLICE + most)], at, high - low, w, known, index, least, best)
    return list(best.values())


def _groups(benchmark: DataFrame, item_col: str, text_col: str) -> list[list]:
    """The items in groups of bounded size, so that what is sent to the executors at once is bounded."""
    small_batches(benchmark.sparkSession)
    items = benchmark.select(F.col(f"`{item_col}`").cast("bigint").alias("item"), F.col(f"`{text_col}`").alias("text")).where("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    n = -(-size // GROUP_BYTES)
    return [[(r["item"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i).orderBy("item", "text").collect()] for i in range(n)]


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start_word, n_words, hamming, similarity): each item that a row of docs contains, with the best
    of its windows (the first among equals).

    An item of fewer than `words` words is one shingle; one without words, or null, matches nothing, as does a null text.
    Repeated items give a row each only if their ids differ; repeated rows of docs give rows each. Empty tables give no
    rows. Columns other than those named are not read. A text of any length is gone through in slices, so that only its
    words' hashes grow with it.
    """
    kept = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = "doc_id bigint, item_id bigint, start_word bigint, n_words bigint, hamming int, similarity double"
    out = docs.sparkSession.createDataFrame([], schema)
    for group in _groups(benchmark, item_col, item_text_col):

        def search(batches, index=Index(group, words)):
            for part in chunks(batches, "text", CHUNK):
                ids = part.column(0).to_pylist()
                rows = [(ids[i], *m) for i, found in _searched(texts_of(part), index, least) for m in found]
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "item_id", "start_word", "n_words", "hamming", "similarity"), r)) for r in rows], schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("hamming", pa.int32()), ("similarity", pa.float64())]))

        out = out.unionByName(kept.mapInArrow(search, schema))
    return out


def _searched(texts: list[str], index: Index, least: float):
    hashes, first = runs(texts, (WORD,))
    # One look at the whole chunk tells which texts have any shingle of an item.
    some = set()
    for w, known in index.known.items():
        at = np.flatnonzero(np.isin(shingled(hashes, w), known))
        some |= set((np.searchsorted(first, at, side="right") - 1).tolist())
    for i in sorted(some):
        if found := matches(hashes[first[i] : first[i + 1]], index, least):
            yield i, found


def keep_clean(docs: DataFrame, benchmark: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs that contain no item, with all columns as they are, whatever their names; text is searched.

    Rows are judged each by itself: repeated ones all stay or all go. A null or empty text contains nothing and stays, as
    does every row where the benchmark is empty.
    """
    for group in _groups(benchmark, "item_id", "text"):

        def clean(batches, index=Index(group, words)):
            for part in chunks(batches, "text", CHUNK):
                bad = {i for i, _ in _searched(texts_of(part), index, least)}
                yield part.filter(pa.array([i not in bad for i in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(clean, T.StructType(docs.schema.fields))
    return docs
