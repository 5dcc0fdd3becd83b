"""Anchored runs of windows: a partition of all windows of a corpus that brings equal windows together.

Every window of W symbols owns an anchor: the K consecutive symbols in it with the smallest hash (the
leftmost of equals). Neighbouring windows often own the same anchor; such a maximal run is one record,
and its text is the slice that its windows cover. As the choice depends on a window's content alone,
equal windows have equal anchors, at the same place in the window. So windows need be compared only
with those of records of the same anchor, wherever in the corpus they are (super-k-mers, as in
k-mer counting: Deorowicz, Kokot, Grabowski, Debudaj-Grabysz, KMC 2, 2015).
"""

from __future__ import annotations

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
PLACE = 22
PIECE = 1 << 20


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """64-bit polynomial hashes of all k consecutive symbols, mixed; k is a power of two."""
    h = (symbols.astype(np.uint64) + np.uint64(1)) * MIX
    power, size = MULTIPLIER, 1
    with np.errstate(over="ignore"):
        while size < k:
            h = h[:-size] * power + h[size:]
            power, size = power * power, size * 2
        h ^= h >> np.uint64(32)
        h *= MIX
        h ^= h >> np.uint64(29)
    return h


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def _runs(symbols: np.ndarray, owner: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor hash) of each run; windows with two owners are none."""
    n = len(symbols) - window + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    h = gram_hashes(symbols, k)
    low = np.uint64((1 << PLACE) - 1)
    best = _sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), window - k + 1)
    place = (best & low).astype(np.int64)
    good = owner[:n] == owner[window - 1 :]
    cut = np.empty(n, bool)
    cut[0] = True
    cut[1:] = (place[1:] != place[:-1]) | (good[1:] != good[:-1]) | (owner[1:n] != owner[: n - 1])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], n) - 1
    keep = good[first]
    first, last = first[keep], last[keep]
    return first, last, h[place[first]]


def records(symbols: np.ndarray, offsets: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, last window, anchor) of every run of documents laid end to end.

    Places are relative to the document. Long documents are cut into overlapping pieces, which only
    cuts runs there; a cut run's halves are still compared with all records of their anchor.
    """
    out = []
    d, docs = 0, len(offsets) - 1
    while d < docs:
        e = d + 1
        while e < docs and offsets[e + 1] - offsets[d] <= PIECE:
            e += 1
        base, end = int(offsets[d]), int(offsets[e])
        owner = np.repeat(np.arange(d, e), np.diff(offsets[d : e + 1]))
        for s in range(base, max(base + 1, end), PIECE):
            stop = min(end, s + PIECE + window - 1)
            first, last, anchor = _runs(symbols[s:stop], owner[s - base : stop - base], window, k)
            who = owner[first + (s - base)]
            shift = s - offsets[who]
            out.append((who, first + shift, last + shift, anchor))
            if e > d + 1 or stop == end:
                break
        d = e
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))
