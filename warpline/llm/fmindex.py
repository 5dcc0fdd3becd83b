"""A compressed FM-index over words: backward search on a wavelet tree kept level by level.

The index of a shard holds the Burrows-Wheeler transform of its texts as bit rows, one for each bit
of a word id (a wavelet matrix: Claude, Navarro, Ordonez, 2015), packed in 64-bit words. Counts of set bits are
kept in two steps, 32 bits for every 512 and 16 bits for every 64 relative to them, so a level takes 1.31 bits a word.
Neither the texts nor the order of the rows is kept.
Queries are searched side by side, a step for each word from a window's end to its start.
"""

from __future__ import annotations

import numpy as np

from warpline.llm.induced import _by_doubling


class FMIndex:
    def __init__(self, ids: np.ndarray, depth: int):
        """ids: words numbered from 1, 0 between texts; rows are ordered by their first `depth` words."""
        n = len(ids)
        self.n = n
        _, dense = np.unique(ids, return_inverse=True)
        rows, _ = _by_doubling(dense, depth) if n > 1 else (np.zeros(n, np.int64), None)
        bwt = ids[rows - 1]  # place 0 is preceded by the last one
        symbols = int(ids.max()) + 1 if n else 1
        self.levels = max(1, int(symbols - 1).bit_length())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=symbols))]).astype(np.int64)
        self.bits, self.blocks, self.counts, self.zeros = [], [], [], []
        now = bwt.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level & 1).astype(np.uint8)
            words = np.packbits(np.pad(bit, (0, -(n + 1) % 512 + 1)), bitorder="little").view(np.uint64)
            before = np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)
            self.bits.append(words)
            self.blocks.append(before[::8].astype(np.uint32))
            self.counts.append((before - np.repeat(before[::8], 8)).astype(np.uint16))
            self.zeros.append(n - int(bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        # where each symbol's stretch starts on the last level
        self.start = self._path(np.arange(symbols), np.zeros(symbols, np.int64))

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (*self.bits, *self.blocks, *self.counts, self.first, self.start))

    def _path(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = at >> 6
            ones = self.blocks[k][at >> 9].astype(np.int64) + self.counts[k][word] + np.bitwise_count(self.bits[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> (self.levels - 1 - k) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place `at` of the transform."""
        return self._path(symbol, at) - self.start[symbol]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of symbol + pattern from the rows [low, high) of the pattern."""
        both = self.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.tile(self.first[symbol], 2)
        return both[: len(low)], both[len(low) :]

    def statistics(self, words: np.ndarray, ends: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics at the ends of queries laid in `words`: (length, low, high).

        The length is that of the longest match, up to limit, that ends before ends[i] and has two
        rows at least; low and high are the rows at which the search stopped.
        """
        q = len(ends)
        low, high, size = np.zeros(q, np.int64), np.full(q, self.n, np.int64), np.zeros(q, np.int64)
        live = np.arange(q)
        for step in range(limit):
            a, b = self.extend(words[ends[live] - 1 - step], low[live], high[live])
            low[live], high[live] = a, b
            live = live[b - a > 1]
            size[live] = step + 1
            if not len(live):
                break
        return size, low, high
