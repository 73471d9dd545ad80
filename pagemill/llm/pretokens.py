"""Pre-tokens of whole texts, and the shuffle that visits each distinct pre-token once.

Documents are read in blocks of bounded size. A block numbers its distinct pre-tokens; a document becomes the
sequence of those numbers (its positions). Only distinct pre-tokens are shuffled: each block sends, for every hash
bucket, the words of that bucket; a bucket's task works on every distinct word once and answers each block; the block's
documents are put together again by position. A word in a third of all rows travels once a block, so no key is hot.
"""

from __future__ import annotations

import functools
import itertools
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from pagemill.llm._common import chunks, code_points, partitions, texts_of

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: The suffixes that the pattern splits after an apostrophe: fixed values.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
CHUNK = 1 << 20


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point, as tiktoken's engine has it.

    The engines differ in code points that a newer Unicode edition assigned. Those (letters or numbers for one engine,
    unassigned for Python) are put to tiktoken itself: with a vocabulary of bytes and of any byte joined to "a" or "1",
    a character merges with the letter or the digit after it if and only if it is of that class.
    """
    every = np.concatenate([np.arange(0xD800, dtype="<u4"), np.arange(0xE000, 0x110000, dtype="<u4")]).tobytes().decode("utf-32-le")
    kind = np.full(len(every), OTHER, np.uint8)
    for k, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            kind[m.start() : m.end()] = k
    ranks = {bytes([i]): i for i in range(256)}
    for after in b"a1":
        ranks |= {bytes([i, after]): len(ranks) + i for i in range(256)}
    asked = tiktoken.Encoding("classes", pat_str=r"\p{L}+|\p{N}+|[^\p{L}\p{N}]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    for i in np.flatnonzero((kind != OTHER) & (kind != SPACE)).tolist():
        if unicodedata.category(c := every[i]) == "Cn":
            one = len(c.encode())
            kind[i] = LETTER if len(asked(c + "a")) == one else NUMBER if len(asked(c + "1")) == one else OTHER
    return np.concatenate([kind[:0xD800], np.full(0x800, OTHER, np.uint8), kind[0xD800:]])


def token_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where a pre-token starts (True), for texts laid end to end; `ends` has each text's start and the total."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = _classes()[points]
    first = np.zeros(n + 1, bool)  # a text starts here
    first[ends] = True
    first = first[:n]
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= first
    # A blank of U+0020 right before a run of another class belongs to that run; of a longer white run the last
    # character stands alone before another class.
    run = np.flatnonzero(start)
    run = run[(run > 0) & ~first[run] & (kind[run] != SPACE)]
    run = run[kind[run - 1] == SPACE]
    start[run - 1] = True
    start[run[points[run - 1] == 0x20]] = False
    # An apostrophe that starts a pre-token and is followed by one of the suffixes.
    tick = np.flatnonzero((points == 0x27) & start)
    tick = tick[tick + 1 < n]
    tick = tick[~first[tick + 1] & (kind[tick + 1] == LETTER)]
    if len(tick):
        one = np.append(points, [0, 0])
        taken = np.zeros(len(tick), np.int64)
        for suffix in CONTRACTIONS:  # the first that fits wins
            fits = (taken == 0) & (one[tick + 1] == ord(suffix[0]))
            if len(suffix) == 2:
                fits &= (one[tick + 2] == ord(suffix[1])) & ~np.append(first, [True, True])[tick + 2]
            taken[fits] = len(suffix)
        tick, taken = tick[taken > 0], taken[taken > 0]
        start[tick + 1] = False
        after = tick + 1 + taken
        after = after[after < n]
        start[after] = True
        # what follows the suffix may be a blank that starts a run, which stays a start; a run's start stays as it was
    return start


def pretokens(texts: list[str]) -> list[list[str]]:
    """The matches of the pattern in each text, in order."""
    points, ends = code_points(texts)
    start = token_starts(points, ends)
    out = []
    for t, a, b in zip(texts, ends, ends[1:]):
        at = np.flatnonzero(start[a:b]).tolist()
        out.append([t[i:j] for i, j in zip(at, [*at[1:], len(t)])])
    return out


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, list[int | None], list[np.ndarray], list[str]]]:
    """(block number, ids, a code sequence for each, words by code) for blocks of at most about `most` bytes."""
    base = TaskContext.get().partitionId() << 32
    block, size, ids, codes, number = 0, 0, [], [], _Numbers()
    for part in chunks(batches, "text", CHUNK):
        if ids and size + part.nbytes > most:
            yield base + block, ids, codes, list(number)
            block, size, ids, codes, number = block + 1, 0, [], [], _Numbers()
        texts = texts_of(part)
        ids += part.column(0).to_pylist()
        for words in pretokens(texts):
            codes.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
        size += part.nbytes
    if ids:
        yield base + block, ids, codes, list(number)


def _by_bucket(words: list[str], buckets: int, prefix: int | None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Order of the words by bucket (a hash of the first `prefix` bytes), each word's bucket in that order, and the words'
    bytes in that order."""
    raw = [w.encode() for w in words]
    of = np.fromiter((xxhash.xxh32_intdigest(w[:prefix]) % buckets for w in raw), np.int64, len(raw))
    order = np.argsort(of, kind="stable")
    return order, of[order], [raw[i] for i in order]


def lookup(docs: DataFrame, answer: Callable[[], Callable[[list[bytes]], list[bytes]]], finish: Callable[[], Callable[[list, list[np.ndarray], list[bytes]], pa.RecordBatch]], schema: str, block_bytes: int, prefix: int | None = None) -> DataFrame:
    """Rows of `finish` for the blocks of docs (doc_id, text; a stored table, which deals the same rows each time).

    answer() gives a function from distinct words in order to their answers; it is called once for all words of a bucket,
    so once for each word of the corpus. Words go to buckets by hash, or by that of their first `prefix` bytes: then
    words with a common beginning of that length meet. A bucket's words stand in memory, those of its blocks packed.
    finish() gives a function (ids, code sequences, answers by code) -> rows.
    """
    spark = docs.sparkSession
    buckets = 4 * partitions(spark)

    def words(batches):
        for block, _, _, found in _blocks(batches, block_bytes):
            _, of, raw = _by_bucket(found, buckets, prefix)
            cut = np.flatnonzero(np.diff(of)) + 1
            for a, b in zip([0, *cut], [*cut, len(raw)]) if raw else ():
                part = raw[a:b]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([int(of[a])], pa.int32()), "block": pa.array([block], pa.int64()), "base": pa.array([int(a)], pa.int32()), "lens": [_packed(np.fromiter(map(len, part), "<u4", len(part)))], "words": [_small(b"".join(part))]})

    def answered(batches):
        reply = answer()
        rows = (row for batch in batches for row in batch.to_pylist())
        for _, same in itertools.groupby(rows, lambda row: row["bucket"]):
            same = list(same)
            distinct = sorted({w for row in same for w in unpack(row["lens"], row["words"])})
            known = dict(zip(distinct, reply(distinct)))
            for row in same:
                out = [known[w] for w in unpack(row["lens"], row["words"])]
                yield pa.RecordBatch.from_pydict({"block": pa.array([row["block"]], pa.int64()), "base": pa.array([row["base"]], pa.int32()), "lens": [_packed(np.fromiter(map(len, out), "<u4", len(out)))], "answers": [_small(b"".join(out))]})

    def coded(batches):
        for block, ids, codes, found in _blocks(batches, block_bytes):
            order, _, _ = _by_bucket(found, buckets, prefix)
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            # Words are numbered as they appear, so that common ones have small numbers; the block's first row places them.
            rows = [(None, place), *zip(ids, codes)]
            for a in range(0, len(rows), 256):
                part = rows[a : a + 256]
                yield pa.RecordBatch.from_pydict({"block": pa.array([block] * len(part), pa.int64()), "doc_id": pa.array([i for i, _ in part], pa.int64()), "places": pa.array([a + i == 0 for i in range(len(part))]), "codes": [_packed(c) for _, c in part]})

    def reassembled(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = sorted(right.select(["base", "lens", "answers"]).to_pylist(), key=lambda r: r["base"])
        answers = [x for r in rows for x in unpack(r["lens"], r["answers"])]
        docs_ = left.filter(pc.invert(left["places"]))
        place = _unpacked(left.filter(left["places"])["codes"][0].as_py())
        codes = [place[_unpacked(c)] for c in docs_["codes"].to_pylist()]
        return pa.Table.from_batches([finish()(docs_["doc_id"].to_pylist(), codes, answers)])

    sent = docs.mapInArrow(words, "bucket int, block bigint, base int, lens binary, words binary")
    back = sent.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(answered, "block bigint, base int, lens binary, answers binary")
    kept = docs.mapInArrow(coded, "block bigint, doc_id bigint, places boolean, codes binary")
    return kept.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(reassembled, schema)


def unpack(lens: bytes, blob: bytes) -> list[bytes]:
    blob, ends = _large(blob), np.cumsum(_unpacked(lens)).tolist()
    return [blob[a:b] for a, b in zip([0, *ends], ends)]


def _small(blob: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(blob)


def _large(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _packed(numbers: np.ndarray) -> bytes:
    """Small 32-bit numbers: first bytes, second bytes, and so on, so that the many zeros are together."""
    return _small(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_large(blob), np.uint8).reshape(4, -1).T).view("<u4").ravel()
