"""External induced sorting of suffixes, with common-prefix values carried along.

The scheme of eSAIS (Bingmann, Fischer, Osipov, Inducing Suffix and LCP Arrays in External Memory,
2013): suffixes are of type L or S; suffixes at left-most S places (S*) are sorted by naming the substrings
between them and solving the string of names by recursion, until names are all different or no more
than BASE; two scans then induce all L suffixes from the S* ones and all S suffixes from the L ones.

A scan is driven by a priority queue of tuples (symbol, order of arrival, place, common prefix with the
forerunner). Symbols are dealt in ranges of about as many suffixes; the queue keeps one first-in-first-out run a
range, beyond MEMORY bytes in an unnamed scratch file of the task, which ends with it. A range is taken whole, and
suffixes that its own suffixes induce within it are put in order by doubling along their chains. A symbol with more suffixes than a
range may have is a range of its own and is taken in blocks of CHUNK, as it needs no order but that of arrival. The common
prefix of two neighbours in a run is one more than the smallest value passed between the two suffixes that induced
them.

Arrays that grow with the shard (text, types, names, orders, prefixes) lie in scratch files beyond MEMORY bytes each, are mapped, and are read
and written in blocks of CHUNK; substrings are named by an external sort, in runs and a merge by blocks; the L and S suffixes are merged
by counts of their symbols. So what must be in memory is a few blocks and one range, not the shard: 64 MB for 32 million symbols, which a test
fixes. Values are cut off at `cap`; suffixes that agree on cap symbols may come in either order.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: names that are ordered in memory; bytes of a queue, or of one array, in memory; rows of a block
BASE, MEMORY, CHUNK = 1 << 10, 2 << 20, 1 << 18
#: ranges of a scan, and their least and greatest size
RANGES, RANGE, WIDEST = 64, 1 << 13, 1 << 17
#: what ran in this process, for tests
RAN = {"levels": 0, "spills": 0, "filed": 0, "merges": 0, "blocks": 0}


def stored(n: int, dtype: type) -> np.ndarray:
    """Zeros, mapped from an unnamed scratch file if they are more than MEMORY bytes."""
    size = n * np.dtype(dtype).itemsize
    if size <= MEMORY:
        return np.zeros(n, dtype)
    RAN["filed"] += 1
    with tempfile.TemporaryFile() as f:  # the mapping keeps it
        f.truncate(size)
        return np.asarray(np.memmap(f, dtype, "r+", shape=(n,)))


def blocks(n: int, start: int = 0) -> Iterator[slice]:
    return (slice(s, min(n, s + CHUNK)) for s in range(start, n, CHUNK))


def mapped(n: int, dtype: type, value, start: int = 0) -> np.ndarray:  # noqa: ANN001
    """An array of n values, filled block by block from value(slice)."""
    out = stored(n, dtype)
    for s in blocks(n, start):
        out[s] = value(s)
    return out


class Runs:
    """First-in-first-out runs of (place, prefix) tuples by number; all in memory go to disk beyond MEMORY."""

    def __init__(self, count: int):
        self.runs: list[list] = [[] for _ in range(count)]
        self.held, self.file = 0, None

    def push(self, run: int, place: np.ndarray, prefix: np.ndarray) -> None:
        self.runs[run].append((place, prefix))
        self.held += place.nbytes + prefix.nbytes
        if self.held > MEMORY:
            self.spill()

    def spill(self) -> None:
        RAN["spills"] += 1
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for run in self.runs:
            for i in range(len(run) - 1, -1, -1):  # what is in memory lies at the end
                if isinstance(run[i][0], int):
                    break
                place, prefix = run[i]
                at = self.file.tell()
                self.file.write(place.tobytes())
                self.file.write(prefix.tobytes())
                run[i] = (at, len(place))
        self.held = 0

    def size(self, run: int) -> int:
        return sum(b if isinstance(a, int) else len(a) for a, b in self.runs[run])

    def parts(self, run: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The run's parts in order; each goes as it is read, and what is pushed meanwhile stays."""
        ready, self.runs[run] = self.runs[run][::-1], []
        while ready:
            a, b = ready.pop()
            if isinstance(a, int):
                self.file.seek(a)
                raw = self.file.read(b * 5)
                a, b = np.frombuffer(raw, np.int32, b), np.frombuffer(raw, np.uint8, b, b * 4)
            else:
                self.held -= a.nbytes + b.nbytes
            yield a, b

    def take(self, run: int) -> tuple[np.ndarray, np.ndarray]:
        got = list(self.parts(run))
        if not got:
            return np.empty(0, np.int32), np.empty(0, np.uint8)
        return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


class Sorter:
    """External sort of (key, item): sorted runs on disk, merged by blocks. What fits in one block is sorted in memory."""

    def __init__(self) -> None:
        self.file, self.runs, self.held, self.size = None, [], [], 0

    def add(self, key: np.ndarray, item: np.ndarray) -> None:
        self.held.append((key, item.astype(np.int32)))
        self.size += len(key)
        if self.size >= CHUNK:
            self._run()

    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        key, item = np.concatenate([h[0] for h in self.held]), np.concatenate([h[1] for h in self.held])
        self.held, self.size = [], 0
        by = np.argsort(key)
        return key[by], item[by]

    def _run(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        key, item = self._sorted()
        at = self.file.seek(0, 2)
        self.file.write(key.tobytes())
        self.file.write(item.tobytes())
        self.runs.append([at, at + key.nbytes, len(key)])  # place of the next key, of the next item, how many are left

    def merged(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All tuples in order of key, a block at a time; equal keys may lie in several blocks."""
        if not self.runs:
            if self.held:
                yield self._sorted()
            return
        if self.held:
            self._run()
        RAN["merges"] += 1
        each = max(16, CHUNK // len(self.runs))
        heads: list = [None] * len(self.runs)
        while True:
            bound = None
            for i, run in enumerate(self.runs):
                if (heads[i] is None or not len(heads[i][0])) and run[2]:
                    n = min(each, run[2])
                    self.file.seek(run[0])
                    key = np.frombuffer(self.file.read(8 * n), np.uint64)
                    self.file.seek(run[1])
                    heads[i] = key, np.frombuffer(self.file.read(4 * n), np.int32)
                    run[0], run[1], run[2] = run[0] + 8 * n, run[1] + 4 * n, run[2] - n
                if run[2]:  # more of this run comes: nothing above what is here may go yet
                    last = heads[i][0][-1]
                    bound = last if bound is None or last < bound else bound
            out = []
            for i, head in enumerate(heads):
                if head is not None and len(head[0]):
                    n = len(head[0]) if bound is None else int(np.searchsorted(head[0], bound, "right"))
                    out.append((head[0][:n], head[1][:n]))
                    heads[i] = head[0][n:], head[1][n:]
            if not out:
                return
            key, item = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
            by = np.argsort(key)
            yield key[by], item[by]


class RangeMin:
    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while (size := 1 << (len(self.rows) - 1)) * 2 <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[: len(last) - size], last[size:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Smallest of values[low : high + 1], low <= high."""
        k = (np.frexp((high - low + 1).astype(np.float64))[1] - 1).astype(np.int64)
        out = np.empty(len(low), self.rows[0].dtype)
        for level in np.unique(k).tolist():
            at = np.flatnonzero(k == level)
            row = self.rows[level]
            out[at] = np.minimum(row[low[at]], row[high[at] + 1 - (1 << level)])
        return out


def extend(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of suffixes a and b, of which `known` symbols are known to agree."""
    out = known.astype(np.int64)
    live = np.flatnonzero(out < cap)
    n = len(text)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        ok = (x < n) & (y < n)
        ok[ok] = text[x[ok]] == text[y[ok]]
        live = live[ok]
        out[live] += 1
        live = live[out[live] < cap]
    return np.minimum(out, cap)


def types(text: np.ndarray) -> np.ndarray:
    """True for S: the suffix is smaller than the next one. The last suffix is L."""
    n = len(text)
    s = stored(n, bool)
    after = False  # type of the suffix after the block
    for part in reversed(list(blocks(n))):
        own = text[part.start : min(n, part.stop + 1)]
        kind = np.full(part.stop - part.start, after)
        differs = np.flatnonzero(own[1:] != own[:-1])
        if len(differs):
            rises = own[differs + 1] > own[differs]
            kind[: differs[-1] + 1] = np.repeat(rises, np.diff(np.concatenate([[-1], differs])))
        s[part] = kind
        after = bool(kind[0])
    return s


def _arranged(text: np.ndarray, entries: np.ndarray, inner: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Order of a range's suffixes: by symbol, in it entries as they arrived, inner ones by what follows them, seeds."""
    place = np.concatenate([entries, inner, seeds])
    symbol = text[place]
    e, n = len(entries), len(place) - len(seeds)
    kind = np.repeat(np.array([0, 1, 2], np.int8), [e, n - e, len(seeds)])
    arrival = np.arange(len(place))
    arrival[e:n] = 0
    order = np.lexsort((arrival, kind, symbol))
    if n == e:
        return order
    tie = np.zeros(len(order), bool)  # the same group as the one before
    k, s = kind[order], symbol[order]
    tie[1:] = (k[1:] == 1) & (k[:-1] == 1) & (s[1:] == s[:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.maximum.accumulate(np.where(tie, 0, np.arange(len(order))))
    by = np.argsort(place)
    after = np.arange(len(place))
    after[e:n] = by[np.searchsorted(place[by], inner + 1)]
    while True:
        r = rank[order]
        same = r[1:] == r[:-1]
        at = np.flatnonzero(np.append(same, False) | np.append(False, same))
        if not len(at):
            return order
        item = order[at]
        key = rank[after[item]]
        turn = np.lexsort((key, rank[item]))
        item, key = item[turn], key[turn]
        order[at] = item
        fresh = np.append(True, (key[1:] != key[:-1]) | (rank[item][1:] != rank[item][:-1]))
        rank[item] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        after = after[after]


def _counts(text: np.ndarray, symbols: int) -> np.ndarray:
    """How often each symbol stands in the text."""
    count = stored(symbols, np.int32)
    for s in blocks(len(text)):
        own = text[s]
        if symbols <= CHUNK:
            count += np.bincount(own, minlength=symbols).astype(np.int32)
        else:
            u, c = np.unique(own, return_counts=True)
            count[u] += c.astype(np.int32)
    return count


def _ranges(text: np.ndarray, symbols: int) -> tuple[np.ndarray, int, set[int]]:
    """(range of each symbol, number of ranges, ranges of one symbol that are too large to be taken whole)."""
    count, step = _counts(text, symbols), max(RANGE, min(WIDEST, len(text) // RANGES))
    out, before, bucket, hot, number, large = stored(symbols, np.int16), 0, 0, False, 0, set()
    for s in blocks(symbols):
        c = count[s].astype(np.int64)
        start = before + np.cumsum(c) - c
        own, heavy = start // step, c > step
        fresh = (own != np.append(bucket, own[:-1])) | heavy | np.append(hot, heavy[:-1])
        out[s] = number + np.cumsum(fresh)
        large |= set(out[s][heavy].tolist())
        before, bucket, hot, number = int(start[-1] + c[-1]), int(own[-1]), bool(heavy[-1]), int(out[s][-1])
    return out, number + 1, large


class Scan:
    """One scan in ascending order; a scanned suffix induces the one before it if that is wanted."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, symbols: int, cap: int):
        self.text, self.wanted, self.cap = text, wanted, cap
        self.range_of, self.ranges, self.large = _ranges(text, symbols)
        self.queue, self.made, self.n_made = Runs(self.ranges), Runs(1), 0
        self.passed = stored(symbols, np.int16)  # smallest prefix since the last push to each symbol; -1: none yet
        for s in blocks(symbols):
            self.passed[s] = -1

    def keep(self, place: np.ndarray, value: np.ndarray) -> None:
        if len(place):
            self.n_made += len(place)
            self.made.push(0, place.astype(np.int32), value)

    def _lower(self, least: np.int16) -> None:
        for s in blocks(len(self.passed)):
            np.minimum(self.passed[s], least, out=self.passed[s])

    def push(self, place: np.ndarray, value: np.ndarray, first: int) -> None:
        """What scanned suffixes induce in ranges from `first` on."""
        text, cap, passed = self.text, self.cap, self.passed
        m, at = len(place), np.flatnonzero(place > 0)
        before = place[at] - 1
        ok = self.wanted[before] & (self.range_of[text[before]] >= first)
        at, before = at[ok], before[ok]
        least = np.int16(value.min())
        if not len(at):
            self._lower(least)
            return
        target = text[before]
        by = np.argsort(target, kind="stable")
        at, before, target = at[by], before[by], target[by]
        first_of = np.append(True, target[1:] != target[:-1])
        low = np.append(0, at[:-1] + 1)
        low[first_of] = 0
        carried = RangeMin(value)(low, at).astype(np.int16)
        heads = np.flatnonzero(first_of)
        carried[heads] = np.minimum(carried[heads], passed[target[heads]])
        carried = np.minimum(carried + 1, cap).astype(np.uint8)
        tails = np.append(heads[1:], len(at)) - 1
        self._lower(least)
        rest = np.minimum.accumulate(value[::-1])[::-1]
        beyond = at[tails] + 1
        passed[target[heads]] = np.where(beyond < m, rest[np.minimum(beyond, m - 1)], cap)
        to = self.range_of[target]  # targets are sorted, so ranges are
        edges = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        for s, e in zip(edges.tolist(), np.append(edges[1:], len(to)).tolist()):
            turn = np.argsort(at[s:e], kind="stable")  # a run keeps the order of arrival
            self.queue.push(int(to[s]), before[s:e][turn].astype(np.int32), carried[s:e][turn])

    def range(self, r: int, seeds: np.ndarray, prefixes: np.ndarray) -> None:
        """A range that is taken whole."""
        text = self.text
        entries, known = self.queue.take(r)
        entries, own = entries.astype(np.int64), seeds.astype(np.int64)
        inner, now = [], np.concatenate([entries, own])
        while len(now):  # what the range's suffixes induce within it
            now = now[now > 0] - 1
            now = now[self.wanted[now]]
            now = now[self.range_of[text[now]] == r]
            inner.append(now)
        within = np.concatenate(inner) if inner else entries
        order = _arranged(text, entries, within, own)
        place = np.concatenate([entries, within, own])[order]
        if not len(place):
            return
        value = np.concatenate([known, np.zeros(len(within), np.uint8), prefixes])[order].astype(np.int16)
        kind = np.repeat(np.array([0, 1, 2], np.int8), [len(entries), len(within), len(own)])[order]
        symbol = text[place]
        value[0] = 0
        fresh = symbol[1:] != symbol[:-1]
        value[1:][fresh] = 0
        seam = np.flatnonzero(~fresh & ((kind[1:] == 1) | (kind[1:] != kind[:-1]))) + 1
        value[seam] = extend(text, place[seam - 1], place[seam], np.ones(len(seam), np.int64), self.cap)
        value = value.astype(np.uint8)
        mine = kind != 2
        self.keep(place[mine], value[mine])
        self.push(place, value, r + 1)

    def symbol(self, r: int, seeds: np.ndarray, prefixes: np.ndarray) -> None:
        """A range of one symbol, block by block: entries as they arrived, those that they induce in it after them, then seeds."""
        RAN["blocks"] += 1
        last = None
        while size := self.queue.size(r):  # what one generation induces in this range is the next one
            few = size <= max(1, CHUNK // 16)
            for place, value in [self.queue.take(r)] if few else self.queue.parts(r):
                place, value = place.astype(np.int64), value.copy()
                if last is None:
                    value[0] = 0
                last = int(place[-1])
                self.keep(place, value)
                self.push(place, value, r + 1 if few else r)
                if few:
                    last = self.chains(place, r)
        for s in blocks(len(seeds)):
            place, value = seeds[s].astype(np.int64), np.array(prefixes[s])
            if s.start == 0:
                value[0] = 0 if last is None else extend(self.text, np.array([last]), place[:1], np.ones(1, np.int64), self.cap)[0]
            self.push(place, value, r + 1)

    def chains(self, place: np.ndarray, r: int) -> int:
        """All that a small generation induces in its own range, many generations at once; returns the last suffix."""
        symbol, last, depth = self.text[place[0]], int(place[-1]), 0
        while len(place):
            deep = max(1, CHUNK // len(place))
            grid = place[None, :] - np.arange(1, deep + 1)[:, None]
            at = np.maximum(grid, 0)
            ok = (grid >= 0) & (self.text[at] == symbol) & self.wanted[at]
            ok = np.logical_and.accumulate(ok, axis=0)
            found = grid[ok]  # generation by generation
            if not len(found):
                break
            level = depth + 1 + np.repeat(np.arange(deep), ok.sum(axis=1))
            # neighbours begin with the symbol as often as their generation says, at least
            value = extend(self.text, np.append(last, found[:-1]), found, np.minimum(level, self.cap), self.cap).astype(np.uint8)
            self.keep(found, value)
            self.push(found, value, r + 1)
            last, place, depth = int(found[-1]), grid[-1][ok[-1]], depth + deep
        return last

    def run(self, seeds: np.ndarray, prefixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """seeds come in ascending order with their common prefix with the seed before. Returned are the
        induced places in ascending order and their common prefix with the induced one before."""
        size = np.zeros(self.ranges, np.int64)
        for s in blocks(len(seeds)):
            size += np.bincount(self.range_of[self.text[seeds[s]]], minlength=self.ranges)
        cuts = np.append(0, np.cumsum(size)).tolist()
        for r in range(self.ranges):
            own = slice(cuts[r], cuts[r + 1])
            (self.symbol if r in self.large else self.range)(r, seeds[own], prefixes[own])
        place, value, at = stored(self.n_made, np.int32), stored(self.n_made, np.uint8), 0
        for a, b in self.made.parts(0):
            place[at : at + len(a)], value[at : at + len(a)] = a, b
            at += len(a)
        return place, value


def _names(text: np.ndarray, s_type: np.ndarray, stars: np.ndarray, symbols: int, cap: int) -> tuple[np.ndarray, int]:
    """(name of each S* substring in their order, number of names).

    From the last columns of symbols to the first, substrings are sorted by a column's symbols and the rank of what follows it.
    """
    n, m = len(text), len(stars)
    size = stored(m, np.int16)
    for s in blocks(m):
        ends = np.append(stars[s.start + 1 : s.stop + 1], [n - 1] * (s.stop == m))
        size[s] = np.minimum(ends - stars[s] + 1, cap + 1)
    bits = (2 * symbols + 2).bit_length()
    per = max(1, 32 // bits)
    rank, count = stored(m, np.int32), 0
    longest = max(int(size[s].max()) for s in blocks(m))
    for c in range(-(-longest // per) - 1, -1, -1):
        sorter = Sorter()
        for s in blocks(m):
            rows = s.start + np.flatnonzero(size[s] > c * per)
            if not len(rows):
                continue
            word, first, own = np.zeros(len(rows), np.uint64), stars[rows].astype(np.int64), size[rows]
            for k in range(c * per, c * per + per):
                at = np.minimum(first + k, n - 1)
                code = (text[at].astype(np.uint64) << np.uint64(1) | s_type[at]) + np.uint64(1)
                word = (word << np.uint64(bits)) | np.where(k < own, code, np.uint64(0))
            sorter.add(word << np.uint64(32) | rank[rows].astype(np.uint64), rows)
        count, last = 0, None
        for key, item in sorter.merged():
            fresh = np.append(last is None or key[0] != last, key[1:] != key[:-1])
            rank[item] = count + np.cumsum(fresh)
            count, last = int(rank[item[-1]]), key[-1]
    for s in blocks(m):
        rank[s] -= 1
    return rank, count


def _by_doubling(names: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of a string of names by `depth` names, and shared names of neighbours."""
    m = len(names)
    ranks, size = [names.astype(np.int64)], 1
    order = np.argsort(names)
    while size < depth:
        r = ranks[-1]
        ordered = r[order]
        # only suffixes that tie with a neighbour need another look
        tied = np.zeros(m, bool)
        same = ordered[1:] == ordered[:-1]
        tied[1:] = same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        place = order[at]
        after = np.zeros(len(place), np.int64)
        inside = place + size < m
        after[inside] = r[place[inside] + size] + 1
        key = r[place] * (m + 1) + after
        turn = np.argsort(key)
        place, key = place[turn], key[turn]
        order[at] = place  # ties keep their stretch of the order
        head = np.concatenate([[True], key[1:] != key[:-1]])
        new = r.copy()
        # a rank is the place in the order of the first of its equals
        if size == 1:
            new[order] = np.arange(m)
        first = at[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        new[place] = first
        ranks.append(new)
        size *= 2
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(m - 1, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        ok = (a < m) & (b < m)
        ok[ok] = ranks[k][a[ok]] == ranks[k][b[ok]]
        step = np.where(ok, 1 << k, 0)
        shared += step
        a, b = a + step, b + step
    return order, shared


def _stars(text: np.ndarray, s_type: np.ndarray, symbols: int, cap: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """S* suffixes in order, with common prefixes."""
    n, found, m = len(text), [], 0
    left = lambda s: s.start + 1 + np.flatnonzero(s_type[s.start + 1 : s.stop + 1] & ~s_type[s.start : min(s.stop, n - 1)])
    found = [len(left(s)) for s in blocks(n)]
    stars = stored(sum(found), np.int32)
    for s, k in zip(blocks(n), found):
        stars[m : m + k] = left(s)
        m += k
    if m < 2:
        return stars, np.zeros(m, np.uint8)
    names, count = _names(text, s_type, stars, symbols, cap)
    depth, shared = cap // 2 + 2, None  # an S* substring moves at least two symbols on
    if count == m:
        order = stored(m, np.int32)
        for s in blocks(m):
            order[names[s]] = np.arange(s.start, s.stop)
    elif m <= base:
        order, between = _by_doubling(np.array(names), depth)
        shared = np.append(0, between)
    else:
        order, shared = suffix_array(names, min(depth, cap), base)
    prefix = stored(m, np.uint8)
    for s in blocks(m, 1):
        a, b = order[s.start - 1 : s.stop - 1].astype(np.int64), order[s].astype(np.int64)
        alike = np.zeros(len(a), np.int64) if shared is None else shared[s].astype(np.int64)
        further = np.maximum(a, b)
        last = np.minimum(further + alike, m - 1) - further  # within the string of names
        x, y = stars[a].astype(np.int64), stars[b].astype(np.int64)
        prefix[s] = extend(text, x, y, np.minimum(stars[a + last] - x, cap), cap)
    return mapped(m, np.int32, lambda s: stars[order[s]]), prefix


def _turned(values: np.ndarray) -> np.ndarray:
    """Common prefixes of a list read from its end: those with the one before."""
    out = stored(len(values), np.uint8)
    for s in blocks(len(values), 1):
        out[s] = values[len(values) - s.stop + 1 : len(values) - s.start + 1][::-1]
    return out


def _merged(text: np.ndarray, s_type: np.ndarray, symbols: int, lefts: tuple[np.ndarray, np.ndarray], rights: tuple[np.ndarray, np.ndarray], cap: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order: within a symbol, L before S. Counts of symbols say where each goes."""
    n_l, n_s = stored(symbols, np.int32), stored(symbols, np.int32)
    for count, (at, _) in ((n_l, lefts), (n_s, rights)):
        for s in blocks(len(at)):
            u, c = np.unique(text[at[s]], return_counts=True)
            count[u] += c.astype(np.int32)
    sum_l = sum_s = 0
    for s in blocks(symbols):  # L up to and with the symbol; S before the symbol
        l_own, s_own = n_l[s].astype(np.int64), n_s[s].astype(np.int64)
        n_l[s], n_s[s] = sum_l + np.cumsum(l_own), sum_s + np.cumsum(s_own) - s_own
        sum_l, sum_s = sum_l + int(l_own.sum()), sum_s + int(s_own.sum())
    n = len(lefts[0]) + len(rights[0])
    place, prefix = stored(n, np.int32), stored(n, np.uint8)
    for (at, near), skipped in ((lefts, n_s), (rights, n_l)):
        for s in blocks(len(at)):
            to = np.arange(s.start, s.stop) + skipped[text[at[s]]]
            place[to], prefix[to] = at[s], near[s]
    last = -1
    for s in blocks(n):
        own = place[s].astype(np.int64)
        key = text[own].astype(np.int64) * 2 + s_type[own]
        seam = np.flatnonzero(key != np.append(last, key[:-1]))
        seam = seam[seam + s.start > 0]
        if len(seam):
            before = np.where(seam > 0, own[seam - 1], place[s.start - 1])
            prefix[s.start + seam] = extend(text, before, own[seam], np.zeros(len(seam), np.int64), cap)
        last = key[-1]
    if n:
        prefix[0] = 0
    return place, prefix


def suffix_array(text: np.ndarray, cap: int, base: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of text (symbols from 0) in order up to cap symbols (at most 255), and the common
    prefix of each with the one before, cut off at cap."""
    if not 0 < cap < 256 or len(text) >= 2**30:
        raise ValueError("cap must be 1 to 255 and a shard less than 2**30 symbols")
    RAN["levels"] += 1
    base = BASE if base is None else base
    n = len(text) + 1  # with a sentinel, below all symbols
    symbols = max((int(text[s].max()) for s in blocks(n - 1)), default=-1) + 2
    given, kind = text, np.int16 if symbols < 2**15 else np.int32
    text = stored(n, kind)
    for s in blocks(n - 1):
        text[s] = given[s].astype(kind) + 1
    s_type = types(text)
    s_type[-1] = True  # the sentinel
    stars, near = _stars(text, s_type, symbols, cap, base)
    if not len(stars):
        stars, near = np.array([n - 1]), np.zeros(1, np.uint8)
    lefts = Scan(text, mapped(n, bool, lambda s: ~s_type[s]), symbols, cap).run(stars, near)
    # the mirrored scan: descending order is ascending order of mirrored symbols
    mirror = mapped(n, kind, lambda s: (symbols - 1) - text[s])
    down, near = Scan(mirror, s_type, symbols, cap).run(lefts[0][::-1], _turned(lefts[1]))
    return _merged(text, s_type, symbols, lefts, (down[::-1], _turned(near)), cap)
