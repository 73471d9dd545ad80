"""Exact removal of repeated passages: every byte covered by a LENGTH-byte string that also starts earlier.

Each window of LENGTH bytes is named by its anchor, the leftmost of its KGRAM-byte strings with the least hash; equal
windows have equal anchors at equal places. Consecutive windows with one anchor occurrence form a snippet. Snippets with
equal bytes repeat each other in full; only the first of them, and only if its anchor has others with different bytes,
can share single windows with another. Those snippets are dealt by anchor to shards, and each shard's suffixes are sorted
by external induction (`induced`), which finds all equal windows within it. There are as many shards as keep each small;
an anchor with too many such snippets for one (a line that most texts have, each between other words) is first narrowed:
its windows by their distance from the anchor, a few at a time, which agree in all but a few bytes if any two are equal.
Likewise a shard sorts no windows that differ from all others at their distance from the anchor in what they would share.

What repeats within a task is settled there, so that a string found in a third of all documents is shuffled once a task.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm import induced
from pagemill.llm._common import NULL_ID, chunks, fresh, materialize, mix, partitions, small_batches
from pagemill.llm.shingles import _powers

LENGTH, KGRAM = 100, 24
#: Texts are taken in buffers of so many bytes; a longer text in pieces of so many windows.
BUFFER = 4 << 20
#: Bits of a packed anchor that hold its place in the buffer.
PLACE = 24
#: Bytes that the queues of one shard may hold in memory; more goes to disk.
QUEUE_MEMORY = 64 << 20
#: Bytes of snippets that a shard has on average, at most, and that one anchor may bring to it; sorting takes some 60 for each.
SHARD, CROWD = 6 << 20, 2 << 20
#: So many windows of a crowded anchor, next to each other, are dealt as one; so many are held against others before the sort.
STEP, SCREEN = 4, 10
#: Texts are hashed so many bytes at a time, whose arrays stay in the processor's cache.
BLOCK = 128 << 10
#: So many rows of snippets are settled at once, at least.
MANY = 1 << 15
_ROWS = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("content", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
_SQL = "kind tinyint, key bigint, content bigint, id bigint, th bigint, a bigint, b bigint"


@functools.lru_cache(1)
def _values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def snippets(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor hash, content hash) of the snippets of texts that lie end to end; ends has each text's
    start and the total. Starts count in the whole; no window crosses the end of a text."""
    k = min(KGRAM, length)
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    forth, back = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_values()[data] * forth[: len(data)], out=sums[1:])
    anchors = mix((sums[k:] - sums[:-k]) * back[: len(data) - k + 1])
    low = (anchors & ~np.uint64((1 << PLACE) - 1)) | np.arange(len(anchors), dtype=np.uint64)
    width, done = length - k + 1, 1
    while done * 2 <= width:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    if done < width:
        low = np.minimum(low[: len(low) - (width - done)], low[width - done :])
    place = (low[:n] & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    valid = np.zeros(len(data) + 1, np.int64)
    long_ = np.diff(ends) >= length
    np.add.at(valid, ends[:-1][long_], 1)
    np.add.at(valid, ends[1:][long_] - length + 1, -1)
    valid = np.cumsum(valid)[:n] > 0
    first = valid.copy()
    first[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    text_start = ends[:-1][ends[:-1] < n]
    first[text_start] |= valid[text_start]
    start = np.flatnonzero(first)
    upto = np.concatenate([[0], np.cumsum(valid)])
    bounds = np.append(start, n)
    windows = upto[bounds[1:]] - upto[bounds[:-1]]
    end = start + windows + length - 1
    return start, windows, anchors[place[start]], mix((sums[end] - sums[start]) * back[start] + windows.astype(np.uint64))


def _blocks(ends: np.ndarray):
    """(first, last + 1) of texts that take about BLOCK bytes together; ends has each text's start and the total."""
    at = 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK, side="right")) - 1)
        yield at, to
        at = to


def _snippets_by_block(texts: list[bytes], ends: np.ndarray, length: int):
    """`snippets` of texts, block by block; starts count in the whole."""
    for i, j in _blocks(ends):
        start, *others = snippets(np.frombuffer(b"".join(texts[i:j]), np.uint8), ends[i : j + 1] - ends[i], length)
        yield start + ends[i], *others


def _merged(group: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the ranges [low, high) of each group; sorted by group and low."""
    if not len(low):
        return group, low, high
    order = np.lexsort((low, group))
    group, low, high = group[order], low[order], high[order]
    shift = np.concatenate([[0], np.cumsum(group[1:] != group[:-1])]) * (int(high.max()) + 1)
    reach = np.maximum.accumulate(high + shift)
    new = np.ones(len(low), bool)
    new[1:] = low[1:] + shift[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(low)) - 1
    return group[at], low[at], reach[last] - shift[last]


def _pieces(ids: list, hashes: list, texts: list[bytes], length: int):
    """(id, th, offset, bytes): texts, long ones in pieces that share length - 1 bytes; in order of id and hash."""
    for i, h, t in sorted(zip(ids, hashes, texts), key=lambda x: x[:2]):
        if len(t) >= length:
            for at in range(0, len(t) - length + 1, BUFFER):
                yield i, h, at, t[at : at + BUFFER + length - 1]


def _scanned(batches, length: int):
    """Snippets of all texts (kind 1: a start, b windows), and ranges that repeat earlier ones of the buffer (kind 0)."""
    for part in chunks(batches, "text", BUFFER):
        yield from _scanned_buffers(list(_pieces(part.column(0).to_pylist(), part.column(1).to_pylist(), [t or b"" for t in part.column(2).to_pylist()], length)), length)


def _scanned_buffers(pieces: list, length: int):
    """By buffers of at most twice BUFFER bytes (a piece is at most about one)."""
    while pieces:
        take, size = 0, 0
        while take < len(pieces) and (not take or size + len(pieces[take][3]) <= 2 * BUFFER):
            size += len(pieces[take][3])
            take += 1
        own, pieces = pieces[:take], pieces[take:]
        ends = np.cumsum([0, *(len(p[3]) for p in own)])
        start, windows, anchor, content = map(np.concatenate, zip(*_snippets_by_block([p[3] for p in own], ends, length)))
        if not len(start):
            continue
        of = np.searchsorted(ends, start, side="right") - 1
        ids, th, offset = (np.array([p[i] for p in own], np.int64) for i in range(3))
        a = start - ends[of] + offset[of]
        order = np.lexsort((content, anchor))
        again = np.zeros(len(order), bool)
        again[1:] = (anchor[order][1:] == anchor[order][:-1]) & (content[order][1:] == content[order][:-1])
        head = order[np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))]
        # a row that repeats the very same place (a repeated document) is no repetition of it
        other = (ids[of[order]] != ids[of[head]]) | (th[of[order]] != th[of[head]]) | (a[order] != a[head])
        first, later = np.sort(order[~again]), order[again & other]
        yield _batch(1, anchor[first].view(np.int64), content[first].view(np.int64), ids[of[first]], th[of[first]], a[first], windows[first])
        if len(later):
            doc = np.searchsorted(np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (th[1:] != th[:-1])])), of[later], side="right")
            some = np.zeros(doc.max() + 1, np.int64)
            some[doc] = of[later]
            group, low, high = _merged(doc, a[later], a[later] + windows[later] + length - 1)
            yield _batch(0, mix(low.astype(np.uint64) + ids[some[group]].astype(np.uint64)).view(np.int64), low * 0, ids[some[group]], th[some[group]], low, high)


def _batch(kind: int, key, content, ids, th, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), *(pa.array(np.ascontiguousarray(x)) for x in (key, content, ids, th, a, b))], schema=_ROWS)


def _matched(batches, length: int):
    """Rows in order of key. Passes ranges on; of each anchor, tells snippets whose bytes came before (as
    ranges) and, if there are different ones, the first of each (kind 1)."""
    held: list[pa.RecordBatch] = []
    n = 0

    def settle(batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches)
        kind, key, content, ids, th, a, b = (table.column(i).to_numpy() for i in range(7))
        if (marks := np.flatnonzero(kind == 0)).size:
            yield _batch(0, key[marks], content[marks], ids[marks], th[marks], a[marks], b[marks])
        snip = np.flatnonzero(kind == 1)
        k = key[snip]
        pair = np.zeros(len(snip), bool)
        pair[1:] = k[1:] == k[:-1]
        shared = pair.copy()
        shared[:-1] |= pair[1:]
        at = snip[shared]
        if not len(at):
            return
        order = np.lexsort((a[at], th[at], ids[at], content[at], key[at]))
        at = at[order]
        same_key = np.concatenate([[False], key[at][1:] == key[at][:-1]])
        again = same_key & np.concatenate([[False], content[at][1:] == content[at][:-1]])
        head = at[np.maximum.accumulate(np.where(again, 0, np.arange(len(at))))]
        other = (ids[at] != ids[head]) | (th[at] != th[head]) | (a[at] != a[head])
        later = at[again & other]
        if len(later):
            yield _batch(0, key[later], content[later], ids[later], th[later], a[later], a[later] + b[later] + length - 1)
        group = np.cumsum(~same_key)
        several = np.bincount(group, weights=~again)[group] > 1
        first = at[~again & several]
        if len(first):
            yield _batch(1, key[first], content[first], ids[first], th[first], a[first], b[first])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < MANY:
            continue
        keys = batch.column(1).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
        if cut or (len(held) > 1 and held[-2].column(1)[-1].as_py() != keys[-1]):
            yield from settle([*held[:-1], batch.slice(0, cut)])
            held = [batch.slice(cut)]
            n = held[0].num_rows
    if held:
        yield from settle(held)


_PIECES = "key bigint, id bigint, th bigint, a bigint, b bigint, piece binary"


def _cut(key, ids, th, a, b, pieces: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*map(pa.array, (key, ids, th, a, b)), pa.array(pieces, pa.binary())], names=["key", "id", "th", "a", "b", "piece"])


def _parts(raw: bytes, windows: np.ndarray, length: int, width: int) -> tuple[np.ndarray, ...]:
    """Snippets that lie end to end in raw, with so many windows each, in parts: windows by their distance from the anchor,
    `width` at a time. (snippet, first window, windows, number of the part, hash of the bytes that all windows at these
    distances share); equal windows are in parts of one number and hash."""
    k = min(KGRAM, length)
    data = np.frombuffer(raw, np.uint8)
    begin = np.cumsum(windows + length - 1) - (windows + length - 1)
    forth, back = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_values()[data] * forth[: len(data)], out=sums[1:])
    grams = mix((sums[k:] - sums[:-k]) * back[: len(data) - k + 1])
    low = np.append((grams & ~np.uint64((1 << PLACE) - 1)) | np.arange(len(grams), dtype=np.uint64), np.uint64(2**64 - 1))
    # the anchor is the least of the strings that lie in all windows of its snippet
    least = np.minimum.reduceat(low, np.stack([begin + windows - 1, begin + length - k + 1], 1).ravel())[::2]
    anchor = (least & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    of = np.repeat(np.arange(len(windows)), windows)
    window = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows) + begin[of]
    number = (anchor[of] - window) // width
    first = np.ones(len(of), bool)
    first[1:] = (of[1:] != of[:-1]) | (number[1:] != number[:-1])
    at = np.flatnonzero(first)
    many = np.diff(np.append(at, len(of)))
    of, start, number = of[at], window[at], number[at]
    left = anchor[of] - number * width
    return of, start - begin[of], many, number, mix((sums[left - width + 1 + length] - sums[left]) * back[left])


def _narrowed(key, ids, th, a, b, pieces: list[bytes], length: int) -> pa.RecordBatch:
    """Snippets (as of `_cut`) of crowded anchors in parts: windows by their distance from the anchor, STEP at a time, dealt by
    the bytes that all windows at these distances share."""
    of, start, windows, number, core = _parts(b"".join(pieces), b, length, STEP)
    dealt = mix(core + mix(key[of].view(np.uint64) + number.astype(np.uint64))).view(np.int64)
    parts = [pieces[i][x : x + n + length - 1] for i, x, n in zip(of.tolist(), start.tolist(), windows.tolist())]
    return _cut(dealt, ids[of], th[of], a[of] + start, windows, parts)


def _cut_out(batches, text_at: int, length: int):
    """The bytes of each wanted snippet, those of crowded anchors narrowed, some thousand a batch, as a batch of few rows costs
    more than they do; rows have id, th and the snippets in their last columns."""
    for batch in batches:
        ids, ths = (batch.column(i).to_numpy() for i in (batch.num_columns - 3, batch.num_columns - 2))
        texts = batch.column(text_at).cast(pa.binary()).to_pylist()
        wanted = batch.column(batch.num_columns - 1)
        of = np.repeat(np.arange(len(texts)), pc.list_value_length(wanted).to_numpy())
        key, a, b, crowded = (x.to_numpy(zero_copy_only=False) for x in wanted.flatten().flatten())
        for some, made in ((~crowded, _cut), (crowded, functools.partial(_narrowed, length=length))):
            places = np.flatnonzero(some)
            for at in range(0, len(places), 4096):
                own = places[at : at + 4096]
                pieces = [texts[i][x:y] for i, x, y in zip(of[own].tolist(), a[own].tolist(), (a[own] + b[own] + length - 1).tolist())]
                yield made(key[own], ids[of[own]], ths[of[own]], a[own], b[own], pieces)


def _distinct(batches, late: list):
    """Of equal pieces the first, as {bytes: (id, th, a, b)}; the others' places come into `late`."""
    first: dict[bytes, tuple] = {}
    for batch in batches:
        for i, th, a, b, piece in zip(*(batch.column(c).to_pylist() for c in range(1, 6))):
            own = (i, th, a, b)
            held = first.setdefault(piece, own)
            if held != own:  # else the piece is new, or a repeated document's
                first[piece] = min(held, own)
                late.append(max(held, own))
    return first


def _screened(pieces: list[bytes], windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(snippet, low, high): of different snippets those that may share a window with another, and which of their windows,
    from low to before high, may be shared. Some of these are not; all that are left out are not."""
    width, found = min(SCREEN, length), []
    for i, j in _blocks(np.cumsum([0, *map(len, pieces)])):
        of, start, many, number, core = _parts(b"".join(pieces[i:j]), windows[i:j], length, width)
        found.append((of + i, start, start + many, mix(core + number.astype(np.uint64))))
    of, low, high, core = map(np.concatenate, zip(*found))
    order = np.argsort(core)
    again = core[order][1:] == core[order][:-1]
    at = np.sort(order[np.append(again, False) | np.append(False, again)])
    head = np.append(True, of[at][1:] != of[at][:-1])[: len(at)]
    return of[at][head], low[at][head], high[at][np.append(head[1:], True)[: len(at)]]


def _sorted_shard(batches, length: int):
    """One shard: the ranges of its snippets that repeat an earlier window."""
    late: list[tuple] = []
    first = _distinct(batches, late)
    for at in range(0, len(late), 1 << 16):
        again = np.array(late[at : at + (1 << 16)], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (again[:, 0], again[:, 1], again[:, 2], again[:, 2] + again[:, 3] + length - 1)], names=["id", "th", "a", "b"])
    if not first:
        return
    pieces = list(first)
    ids, th, a, windows = np.array(list(first.values()), np.int64).T.copy()
    del first, late
    own, low, high = _screened(pieces, windows, length)
    if not len(own):
        return
    ids, th, a, windows = ids[own], th[own], a[own] + low, high - low
    pieces = [pieces[i][x : y + length - 1] for i, x, y in zip(own.tolist(), low.tolist(), high.tolist())]
    begins = np.cumsum([0, *(len(p) + 1 for p in pieces)])
    text = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8).astype(np.uint16) + np.uint16(1)
    text[begins[1:] - 1] = 0
    del pieces
    found_of, found_at = [], []
    size, held = 0, []

    def flush():
        """Of groups of equal windows, all but the earliest."""
        at, sizes = map(np.concatenate, zip(*held))
        group = np.repeat(np.arange(len(sizes)), sizes)
        of = np.searchsorted(begins, at, side="right") - 1
        inside = at - begins[of] < windows[of]
        at, group, of = at[inside], group[inside], of[inside]
        start = a[of] + at - begins[of]
        order = np.lexsort((start, th[of], ids[of], group))
        of, start, group = of[order], start[order], group[order]
        first = np.ones(len(of), bool)
        first[1:] = group[1:] != group[:-1]
        head = np.maximum.accumulate(np.where(first, np.arange(len(of)), 0))
        later = (ids[of] != ids[of[head]]) | (th[of] != th[of[head]]) | (start != start[head])
        found_of.append(of[later])
        found_at.append(start[later])

    for positions, sizes in induced.many_groups(text, length, QUEUE_MEMORY):
        held.append((positions, sizes))
        size += len(positions)
        if size > 1 << 20:
            flush()
            size, held = 0, []
    if held:
        flush()
    if not found_of:
        return
    of, at = np.concatenate(found_of), np.concatenate(found_at)
    group, low, high = _merged(of, at, at + length)
    for i in range(0, len(low), 1 << 16):
        s = slice(i, i + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(ids[group[s]]), pa.array(th[group[s]]), pa.array(low[s]), pa.array(high[s])], names=["id", "th", "a", "b"])


def _keyed(docs: DataFrame, id_col: str, text_col: str, id_name: str, th_name: str) -> tuple[DataFrame, bool]:
    """docs with an integer id (null: the smallest) and, where ids repeat (it says so, too), a hash of the text that tells
    rows apart."""
    ident = F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(NULL_ID))
    repeats = docs.groupBy(ident.alias("i")).count().where("count > 1").limit(1).count()
    return docs.withColumns({id_name: ident, th_name: F.xxhash64(F.col(f"`{text_col}`")) if repeats else F.lit(0).cast("bigint")}), bool(repeats)


def with_ranges(docs: DataFrame, length: int, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """docs with one more column (its name is returned): the byte ranges to remove, unmerged; null where there are none.

    Of rows with one id, the text's hash decides which is earlier; rows that repeat id and text are one document.
    """
    spark = small_batches(docs.sparkSession)
    ranges, i, t = fresh(docs, "ranges"), fresh(docs, "row_id"), fresh(docs, "row_hash")
    keyed, repeats = _keyed(docs, id_col, text_col, i, t)
    names = {"id": i, "th": t} if repeats else {"id": i}
    binary = F.col(f"`{text_col}`").cast("binary")
    own = keyed.select(F.col(i).alias("id"), F.col(t).alias("th"), binary.alias("text"))
    found = own.mapInArrow(lambda b: _scanned(b, length), _SQL)
    sorted_ = found.repartition(partitions(spark), "key").sortWithinPartitions("key")  # by one number, which Spark sorts by its digits
    matched = materialize(sorted_.mapInArrow(lambda b: _matched(b, length), _SQL), "snippets")
    firsts = matched.where("kind = 1")
    weight = firsts.groupBy("key").agg(F.sum(F.col("b") + length - 1).alias("n"))
    crowded = F.broadcast(weight.where(F.col("n") > CROWD).select("key", F.lit(True).alias("crowded")))  # a row for each CROWD bytes at most
    pieces = firsts.join(crowded, "key", "left").fillna(False, ["crowded"])
    dealt_bytes = F.when(F.col("crowded"), (F.floor(F.col("b") / STEP) + 1) * (length - 1 + STEP)).otherwise(F.col("b") + length - 1)
    shards = max(partitions(spark), -(-(pieces.agg(F.sum(dealt_bytes)).first()[0] or 0) // SHARD))
    # Both joins below read one shuffle of the documents: they take the same columns of it.
    dealt = keyed.repartition(partitions(spark), *names.values())
    wanted = pieces.groupBy(*names).agg(F.collect_list(F.struct("key", "a", "b", "crowded")).alias("wanted"))
    same = lambda other: [F.col(own) == other[c] for c, own in names.items()]
    texts = dealt.join(wanted, same(wanted)).select(*[F.col(f"`{c}`") for c in docs.columns], i, t, "wanted")
    text_at = docs.columns.index(text_col)
    cut = texts.mapInArrow(lambda b: _cut_out(b, text_at, length), _PIECES)
    late = cut.repartition(shards, "key").mapInArrow(lambda b: _sorted_shard(b, length), "id bigint, th bigint, a bigint, b bigint")
    every = matched.where("kind = 0").select("id", "th", "a", "b").unionByName(late).groupBy(*names).agg(F.collect_list(F.struct("a", "b")).alias(ranges))
    return dealt.join(every, same(every), "left").select(*[F.col(f"`{c}`") for c in docs.columns], ranges), ranges


def cut_ranges(text: bytes, ranges: list[dict] | None) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal removed runs)."""
    if not ranges:
        return text, 0, 0
    runs: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in ranges):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    edges = [0, *(x for run in runs for x in run), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])), sum(b - a for a, b in runs), len(runs)


def whole_characters(text: bytes, ranges: list[dict]) -> list[dict]:
    """Ranges of UTF-8 bytes, widened to whole characters."""
    inside = lambda at: 0 <= at < len(text) and text[at] & 0xC0 == 0x80
    out = []
    for r in ranges:
        a, b = r["a"], r["b"]
        while inside(a):
            a -= 1
        while inside(b):
            b += 1
        out.append({"a": a, "b": b})
    return out


def digest(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs, texts being UTF-8 bytes.

    A byte is removed if a string of `length` bytes that covers it also starts earlier: in a row of smaller id, or
    earlier in the same text; overlaps count, and the input alone decides. A null text counts as empty, a null id as the
    smallest. Of rows with one id and different texts the text's hash decides the order; rows that repeat id and text are
    one document and give a row each. Texts shorter than `length` stay whole. An empty table gives no rows; columns other
    than the two named are not read. docs must be a stored table.
    """
    rows, ranges = with_ranges(docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), length, "doc_id", "text")

    def digested(batches):
        for part in chunks(batches, "text", BUFFER):
            out = []
            for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                left, removed, spans = cut_ranges(text or b"", found)
                out.append((len(text or b""), removed, spans, hashlib.sha256(left).hexdigest()))
            n, r, s, h = zip(*out)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(h, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.select("doc_id", F.col("text").cast("binary").alias("text"), ranges).mapInArrow(digested, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated bytes cut out of the text column (as in `digest`), all columns kept.

    A character of which any byte goes goes as a whole, so that texts stay UTF-8 and no new character arises. A null text
    stays null.
    """
    rows, ranges = with_ranges(docs, length, id_col, text_col)

    def cut(batches):
        for part in chunks(batches, text_col, BUFFER):
            at = part.schema.get_field_index(text_col)
            texts = []
            for t, r in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist()):
                if r:
                    raw = t.encode()
                    t = cut_ranges(raw, whole_characters(raw, r))[0].decode()
                texts.append(t)
            kept = part.drop_columns([ranges])
            yield kept.set_column(at, kept.schema.field(at), pa.array(texts, pa.string()))

    return rows.mapInArrow(cut, T.StructType(docs.schema.fields))
