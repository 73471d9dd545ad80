"""Language identification by n-gram filters that answer for all languages at once.

The filter is a Bloom filter in bit-sliced form: a cell holds one bit for each language, so that the conjunction of an
n-gram's cells is the mask of all languages whose set contains it. A text's hits are counted for each language; a
language whose slice is full to the share f answers falsely with probability f ** HASHES, which the counts are corrected
for: (hits - n * p) / (1 - p). The language with most corrected hits wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm._common import chunks, code_points, mix, small_batches, texts_of
from pagemill.llm.pretokens import LETTER, _classes

N = 3
HASHES = 3
CELLS = 1 << 18
#: The sample that is learned from: about so many documents of each language, chosen by a hash of their ids.
MOST_DOCS = 4000
#: A language's set has the n-grams seen LEAST_COUNT times or more whose share among its n-grams is at least so large
#: a part of the largest share in any language.
LEAST_COUNT, LEAST_SHARE = 3, 0.3
CHUNK = 1 << 20


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed trigrams around each letter (lower case; what is no letter counts as a blank), the texts' first (one more
    at the end), and whether a text has a letter."""
    points, ends = code_points([" " + t.lower() + " " for t in texts])
    letters = _classes()[points] == LETTER
    at = np.flatnonzero(letters)
    p = np.where(letters, points, 32).astype(np.uint64)
    keys = (p[at - 1] << np.uint64(42)) | (p[at] << np.uint64(21)) | p[at + 1]
    first = np.searchsorted(at, ends)
    return keys, first, first[1:] > first[:-1]


def _cells(keys: np.ndarray) -> list[np.ndarray]:
    h = mix(keys)
    return [((h >> np.uint64(20 * i)) & np.uint64(CELLS - 1)).astype(np.int64) for i in range(HASHES)]


class Filter:
    """cells[w] has the bits of the languages 64 w to 64 w + 63."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counts)
        self.common = max(self.languages, key=lambda x: (counts[x][1].sum(), x), default=None)
        keys = np.unique(np.concatenate([k for k, _ in counts.values()])) if counts else np.zeros(0, np.uint64)
        shares = np.zeros((len(self.languages), len(keys)))
        often = np.zeros_like(shares)
        for i, x in enumerate(self.languages):
            own, n = counts[x]
            at = np.searchsorted(keys, own)
            often[i, at], shares[i, at] = n, n / max(1, n.sum())
        within = (often >= LEAST_COUNT) & (shares >= LEAST_SHARE * shares.max(0, initial=0))
        self.cells = [np.zeros(CELLS, np.uint64) for _ in range(-(-len(self.languages) // 64))]
        fill = []
        for i in range(len(self.languages)):
            bit, word = np.uint64(1 << (i % 64)), self.cells[i // 64]
            for c in _cells(keys[within[i]]):
                word[np.unique(c)] |= bit
            fill.append(np.count_nonzero(word & bit) / CELLS)
        self.false = np.array(fill) ** HASHES

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        keys, first, lettered = grams(texts)
        n = np.diff(first)
        hits = np.zeros((len(self.languages), len(texts)))
        cells = _cells(keys)
        for w, word in enumerate(self.cells):
            mask = word[cells[0]]
            for c in cells[1:]:
                mask &= word[c]
            for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                upto = np.zeros(len(mask) + 1, np.int64)
                np.cumsum((mask >> np.uint64(i % 64)) & np.uint64(1), out=upto[1:])
                hits[i] = upto[first[1:]] - upto[first[:-1]]
        hits = np.maximum(0, (hits - n * self.false[:, None]) / (1 - self.false[:, None]).clip(1e-9))
        names, scores = [], np.zeros(len(texts))
        for j in range(len(texts)):
            if not lettered[j] or not self.languages:
                names.append("und")
                continue
            order = np.argsort(-hits[:, j], kind="stable")
            best = hits[order[0], j]
            second = hits[order[1], j] if len(order) > 1 else 0.0
            names.append(self.languages[order[0]] if best > 0 else self.common)
            scores[j] = best / (best + second) if best > 0 else 0.0
        return names, scores


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", most_docs: int = MOST_DOCS) -> Filter:
    """Learn the languages that the rows state, from about most_docs of each; rows without a language are not used."""
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text")).where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Filter({})
    part = F.lit(0.0)
    for name, n in sorted(sizes.items()):
        part = F.when(F.col("lang") == name, F.lit(min(1.0, most_docs / n))).otherwise(part)
    sample = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part * (1 << 20))

    def count(batches):
        for chunk in chunks(batches, "text", CHUNK):
            keys, first, _ = grams(texts_of(chunk))
            langs = np.array(chunk.column(1).to_pylist(), object)
            of = np.repeat(langs, np.diff(first))
            for name in set(langs):
                own_keys, n = np.unique(keys[of == name], return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(n), pa.string()), "gram": pa.array(own_keys.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    found = sample.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT).toPandas()
    return Filter({x: (g["gram"].to_numpy(np.uint64), g["n"].to_numpy(np.int64)) for x, g in found.groupby("lang")})


def identify(docs: DataFrame, learned: Filter, text_col: str = "text", id_col: str = "doc_id", *more) -> DataFrame:
    """(doc_id, [more,] lang_pred, score) for each row of docs, from the whole text alone.

    The model has a fixed size (CELLS cells a 64 languages). A text that is null or has no letter is `und` with score 0,
    as is every text if no language was learned; one without any hit gets the most common learned language and score 0;
    among equal counts the first language in order wins. The score is the winner's share of its and the second's
    corrected hits. Repeated rows give a row each, an empty table none; columns not named are not read.
    """

    def predict(batches):
        for chunk in chunks(batches, "text", CHUNK):
            names, scores = learned.decide(texts_of(chunk))
            yield pa.RecordBatch.from_arrays([*chunk.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*chunk.schema.names[:-1], "lang_pred", "score"])

    small_batches(docs.sparkSession)
    kept = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *more, F.col(f"`{text_col}`").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(predict, f"{schema}, lang_pred string, score double")
