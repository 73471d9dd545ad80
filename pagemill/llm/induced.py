"""Suffix sorting by induction, with truncated common-prefix values, on disk-backed queues.

The sorted order of the LMS suffixes (each smaller than its left and right neighbours) induces that of all others: taken
in order, a suffix places its predecessor in the queue of the predecessor's first symbol. A queue holds tuples (position,
common prefix with its forerunner in the queue); by symbol and arrival it is the priority queue of the method. A batch of
the stream is taken at once; the common prefix of two placed neighbours is one more than the least common prefix in the
stream between their causes. The LMS substrings are sorted by the same induction and named; where names repeat, the
reduced string of names is solved in turn, and gives the order of the LMS suffixes.

Orders and values are exact to a depth of `depth` symbols, which is all that is asked for here.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Symbols are 1..256 for bytes, 0 ends a piece of text.
SYMBOLS = 257
#: So many suffixes of a stream are taken at once.
BATCH = 1 << 20


class Queue:
    """Arrays (positions, prefixes) in order of arrival. What exceeds its share of memory goes to a file."""

    def __init__(self, share: int):
        self.share, self.chunks, self.held, self.file, self.stored, self.rows = share, [], 0, None, 0, 0

    def append(self, positions: np.ndarray, prefixes: np.ndarray) -> None:
        self.chunks.append((positions, prefixes))
        self.rows += len(positions)
        self.held += positions.nbytes + prefixes.nbytes
        if self.held > self.share:
            self.file = self.file or tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            for i in range(self.stored, len(self.chunks)):
                p, q = self.chunks[i]
                self.file.write(p.astype(np.int64).tobytes() + q.tobytes())
                self.chunks[i] = (at, len(p))
                at += 9 * len(p)
            self.stored, self.held = len(self.chunks), 0

    def _read(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i >= self.stored:
            return self.chunks[i]
        at, n = self.chunks[i]
        self.file.seek(at)
        raw = self.file.read(9 * n)
        return np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.uint8, n, 8 * n)

    def batches(self, backwards: bool = False):
        """In order, with those that arrive meanwhile; backwards: the last first, each batch as it is."""
        low, high = 0, len(self.chunks)
        while low < (high if backwards else len(self.chunks)):
            own, n = [], 0
            while low < (high if backwards else len(self.chunks)) and n < BATCH:
                if backwards:
                    high -= 1
                own.append(self._read(high if backwards else low))
                n += len(own[-1][0])
                low += not backwards
            own = own[::-1] if backwards else own
            yield own[0] if len(own) == 1 else tuple(map(np.concatenate, zip(*own)))

    def last(self) -> int:
        return int(self._read(len(self.chunks) - 1)[0][-1])

    def close(self) -> None:
        if self.file:
            self.file.close()
        self.chunks, self.stored, self.file = [], 0, None


class _Least:
    """Least common prefixes between placed neighbours of one stream."""

    def __init__(self, depth: int):
        self.depth = depth
        self.since = np.full(SYMBOLS, -1, np.int64)  # least since the last placement in each queue; -1: none placed yet

    def place(self, prefixes: np.ndarray, at: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the items `at` of a batch (with their predecessors' symbols): their order by queue, and the values there."""
        order = np.argsort(symbols, kind="stable")
        i, s = at[order], symbols[order]
        n = len(prefixes)
        table = [prefixes]
        while 2 << (len(table) - 1) <= n:
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))

        def least(low, high):  # of prefixes[low:high], not empty
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            out = np.empty(len(low), np.uint8)
            for k in np.unique(level):
                m = level == k
                out[m] = np.minimum(table[k][low[m]], table[k][high[m] - (1 << int(k))])
            return out.astype(np.int64)

        head = np.ones(len(i), bool)
        head[1:] = s[1:] != s[:-1]
        low = np.zeros(len(i), np.int64)
        low[1:][~head[1:]] = i[:-1][~head[1:]] + 1
        values = least(low, i + 1) if len(i) else np.zeros(0, np.int64)
        first = self.since[s[head]]
        values[head] = np.where(first < 0, -1, np.minimum(first, values[head]))
        tail = np.append(head[1:], True) if len(i) else head
        every = int(prefixes.min()) if n else 255
        self.since = np.where(self.since >= 0, np.minimum(self.since, every), -1)
        if len(i):
            rest, full = i[tail] + 1, np.full(tail.sum(), n)
            some = rest < n
            after = np.full(len(rest), 255, np.int64)
            after[some] = least(rest[some], full[some])
            self.since[s[tail]] = after
        return order, np.minimum(values + 1, self.depth).astype(np.uint8)


def _run(text: np.ndarray, at: int, depth: int) -> int:
    part = text[at : at + depth]
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


def _batched(positions: np.ndarray, prefixes: np.ndarray):
    for a in range(0, len(positions), BATCH):
        yield positions[a : a + BATCH], prefixes[a : a + BATCH]


def induce(text: np.ndarray, starts: np.ndarray, prefixes: np.ndarray, depth: int, share: int):
    """Queues (small, large) by symbol: small[c] has the L suffixes in ascending order, large[c] the S suffixes in
    descending order, each with the common prefix with its forerunner. starts: LMS positions in order."""
    small, large = ([Queue(share) for _ in range(SYMBOLS)] for _ in range(2))
    bounds = np.searchsorted(text[starts], np.arange(SYMBOLS + 1))
    least = _Least(depth)

    def placed(queues, positions, prefix, fits):
        before = positions - 1
        ok = positions > 0
        symbol = text[before]
        ok &= fits(symbol)
        at = np.flatnonzero(ok)
        order, values = least.place(prefix, at, symbol[at])
        at = at[order]
        symbols, targets = symbol[at], before[at]
        cut = np.flatnonzero(np.diff(symbols)) + 1
        for a, b in zip([0, *cut], [*cut, len(at)]) if len(at) else ():
            queues[int(symbols[a])].append(targets[a:b], values[a:b])

    for c in range(SYMBOLS):
        for p, q in small[c].batches():
            for bp, bq in _batched(p, q):
                placed(small, bp, bq, lambda s: s >= c)
        own, ownq = starts[bounds[c] : bounds[c + 1]], prefixes[bounds[c] : bounds[c + 1]].copy()
        if len(own):
            ownq[0] = min(_run(text, small[c].last(), depth), _run(text, int(own[0]), depth)) if small[c].rows else 0
            for bp, bq in _batched(own, ownq):
                placed(small, bp, bq, lambda s: s > c)
    least = _Least(depth)
    for c in range(SYMBOLS - 1, -1, -1):
        for p, q in large[c].batches():
            for bp, bq in _batched(p, q):
                placed(large, bp, bq, lambda s: s <= c)
        if small[c].rows:
            edge = min(_run(text, large[c].last(), depth), _run(text, small[c].last(), depth)) if large[c].rows else 0
            for p, q in small[c].batches(True):
                back, first = np.append(q[1:], np.uint8(edge))[::-1], int(q[0])
                for bp, bq in _batched(p[::-1], back):
                    placed(large, bp, bq, lambda s: s < c)
                edge = first
    return small, large


def _types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes: smaller than the one that starts one later. The last symbol counts as S."""
    n = len(text)
    up = np.zeros(n, bool)
    up[:-1] = text[:-1] < text[1:]
    up[-1] = True
    differs = np.ones(n, bool)
    differs[:-1] = text[:-1] != text[1:]
    nxt = np.where(differs, np.arange(n), n - 1)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    return up[nxt]


def _solved(names: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the reduced string's suffixes, by pairs of ranks at doubled distance, until all differ or the distance
    covers `depth` symbols of the text below (places: where each name starts there)."""
    n, step = len(names), 1
    rank = names.astype(np.int64)
    active = np.arange(n)
    while step < n and int((np.append(places, places[-1] + depth)[np.minimum(active + step, n)] - places[active]).min()) < depth:
        later = np.zeros(len(active), np.int64)
        inside = active + step < n
        later[inside] = rank[active[inside] + step] + 1
        order = np.argsort(rank[active] * (n + 1) + later)  # both are at most n
        r, x, who = rank[active][order], later[order], active[order]
        new_group = np.ones(len(who), bool)
        new_group[1:] = r[1:] != r[:-1]
        group = np.maximum.accumulate(np.where(new_group, np.arange(len(who)), 0))
        changed = new_group.copy()
        changed[1:] |= x[1:] != x[:-1]
        offset = np.maximum.accumulate(np.where(changed, np.arange(len(who)), 0)) - group
        rank[who] = r + offset
        sole = changed & np.append(changed[1:], True)
        active = np.sort(who[~sole])
        if not len(active):
            break
        step *= 2
    return rank


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of the different suffixes a[i] and b[i], up to depth; four symbols a round for those still equal.

    Four symbols are one number, read through overlapping views; behind the end stand signs that equal none.
    """
    ended = np.append(text.astype("<u2"), np.full(4, 0xFFFF, "<u2"))
    four = np.ndarray((len(text) + 1,), "<u8", ended, 0, (2,))
    out = np.zeros(len(a), np.int64)
    alive = np.arange(len(a))
    done = 0
    while len(alive) and done < depth:
        apart = four[a[alive] + done] ^ four[b[alive] + done]
        differ = apart != 0
        first = apart[differ]
        out[alive[differ]] = done + sum((first & np.uint64((1 << 16 * k) - 1) == 0).astype(np.int64) for k in (1, 2, 3))
        alive = alive[~differ]
        done += 4
    out[alive] = done
    return np.minimum(out, depth).astype(np.uint8)


def sorted_suffixes(text: np.ndarray, depth: int, memory: int = 64 << 20):
    """The queues of `induce` for all suffixes of text (symbols below SYMBOLS, the last one 0)."""
    share = memory // (2 * SYMBOLS)
    s = _types(text)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if not len(lms):
        lms = np.array([len(text) - 1])
    # LMS substrings: induction from the LMS positions in order of their first symbols only.
    by_symbol = lms[np.argsort(text[lms], kind="stable")]
    small, large = induce(text, by_symbol, np.zeros(len(lms), np.uint8), depth, share)
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    order = []
    for c in range(SYMBOLS):
        for p, _ in large[c].batches(True):
            order.append(p[is_lms[p]][::-1])
        small[c].close()
        large[c].close()
    order = np.concatenate(order) if order else lms
    if len(order) < len(lms):  # the very last position is nobody's predecessor
        order = np.concatenate([lms[-1:], order])
    number = np.searchsorted(lms, order)
    ends = np.append(lms[1:], len(text) - 1)
    length = ends[number] - lms[number] + 1
    same = np.zeros(len(order), bool)
    same[1:] = length[1:] == length[:-1]
    capped = np.minimum(length, depth)
    at = np.flatnonzero(same)
    same[at] = _common(text, order[at], order[at - 1], depth) >= capped[at]
    names = np.empty(len(lms), np.int64)
    group = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    names[number] = group
    rank = names if not same.any() else _solved(names, lms, depth)
    starts = lms[np.argsort(rank, kind="stable")]
    prefixes = np.zeros(len(starts), np.uint8)
    prefixes[1:] = _common(text, starts[1:], starts[:-1], depth)
    return induce(text, starts, prefixes, depth, share)


def groups(text: np.ndarray, depth: int, memory: int = 64 << 20):
    """Arrays of positions whose next `depth` symbols are equal, for every such string that occurs twice or more; see
    `many_groups`."""
    for positions, sizes in many_groups(text, depth, memory):
        yield from np.split(positions, np.cumsum(sizes)[:-1])


def many_groups(text: np.ndarray, depth: int, memory: int = 64 << 20):
    """(positions, sizes) of such groups, one after another; with `memory` bytes for the queues. Positions whose string
    would cross an end mark (0) are left out by the caller."""
    small, large = sorted_suffixes(text, depth, memory)
    for c in range(1, SYMBOLS):
        held = np.zeros(0, np.int64)
        edge = 0
        if small[c].rows and large[c].rows:
            edge = min(_run(text, large[c].last(), depth), _run(text, small[c].last(), depth))

        def stream():
            for p, q in small[c].batches():
                yield p, q
            first = True
            nxt = edge
            for p, q in large[c].batches(True):
                prefix = np.append(q[1:], np.uint8(nxt))[::-1]
                nxt = q[0]
                yield p[::-1], prefix

        for p, q in stream():
            joins = q >= depth
            p = np.concatenate([held, p])
            joins = np.concatenate([np.ones(len(held), bool), joins])
            if len(joins):
                joins[0] = len(held) > 0 and joins[0]
            starts = np.flatnonzero(~joins | (np.arange(len(p)) == 0))
            sizes = np.diff(starts)
            if (sizes > 1).any():
                yield p[: starts[-1]][np.repeat(sizes > 1, sizes)], sizes[sizes > 1]
            held = p[starts[-1] :] if len(starts) else held
        if len(held) > 1:
            yield held, np.array([len(held)])
        small[c].close()
        large[c].close()
