"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Code points map to classes by one table lookup; a small automaton over the classes finds English
contractions and token starts. Its transition functions form a finite monoid, so runs of a text are
composed independently and joined afterwards: an associative scan, not a regular expression. The
slices between boundaries are merged by rank once and cached; ids keep the byte offsets of their
slices, and decoding joins the bytes of ids. Texts are taken in groups, a line feed between two of them: it
brings the automaton to its first state, and its own slice is dropped.

Defined cases: null and empty texts give no ids; ids outside the vocabulary can't occur, as every
single byte is a token; repeated rows are encoded alike; an empty table gives an empty table. Extra
columns are not read. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from warpline.llm.common import id_text, small_batches, table

# classes of code points
SPACE, BLANK, LETTER, DIGIT, OTHER, APOS, L_STMD, L_R, L_V, L_L, L_E = range(11)
GROUP = np.array([0, 0, 1, 2, 3, 3, 1, 1, 1, 1, 1], np.uint8)  # white space, letters, numbers, others
#: fixed values: code points that the pattern's \s matches
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def classes() -> np.ndarray:
    kinds = "".join(unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1))
    raw = np.frombuffer(kinds.encode(), np.uint8)
    out = np.full(len(raw), OTHER, np.uint8)
    out[raw == ord("L")], out[raw == ord("N")] = LETTER, DIGIT
    out[WHITE], out[32], out[39] = BLANK, SPACE, APOS
    for chars, kind in (("stmd", L_STMD), ("r", L_R), ("v", L_V), ("l", L_L), ("e", L_E)):
        out[[ord(c) for c in chars]] = kind
    return out


# states: what the token being read is
AFTER_SPACE, FRESH, IN_OTHER, QUOTE, QUOTE_RV, QUOTE_L, CUT = range(7)


def _step(state: int, kind: int) -> int:
    """FRESH: an apostrophe that comes next starts a token. CUT: this letter ends a contraction."""
    if kind == SPACE:
        return AFTER_SPACE
    if kind == OTHER:
        return IN_OTHER
    if kind == APOS:
        return IN_OTHER if state in (AFTER_SPACE, IN_OTHER, QUOTE) else QUOTE
    if state == QUOTE:
        return {L_STMD: CUT, L_R: QUOTE_RV, L_V: QUOTE_RV, L_L: QUOTE_L}.get(kind, FRESH)
    if state == QUOTE_RV and kind == L_E or state == QUOTE_L and kind == L_L:
        return CUT
    return FRESH


@functools.cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element of each class, products of elements, element x state -> state): closure of the classes' functions."""
    gens = [tuple(_step(s, k) for s in range(7)) for k in range(11)]
    known = {tuple(range(7)): 0}
    order = [tuple(range(7))]
    for f in order:
        for g in gens:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(order)
                order.append(h)
    size = len(order)
    product = np.array([[known[tuple(g[s] for s in f)] for g in order] for f in order], np.uint16)
    assert size < 2**16
    return np.array([known[g] for g in gens], np.uint16), product, np.array(order, np.uint8)


def states(kinds: np.ndarray, start: int = FRESH, run: int = 128) -> np.ndarray:
    """State after each code point: functions of runs are scanned side by side, then runs are chained."""
    element, product, acts = monoid()
    n = len(kinds)
    rows = -(-n // run)
    f = np.zeros(rows * run, np.uint16)
    f[:n] = element[kinds]
    f = np.ascontiguousarray(f.reshape(rows, run).T)
    flat, size = product.reshape(-1), product.shape[0]
    for i in range(1, run):
        f[i] = flat[f[i - 1].astype(np.int64) * size + f[i]]
    entry = np.empty(rows, np.uint8)
    state = start
    for r, last in enumerate(f[-1].tolist()):
        entry[r] = state
        state = acts[last, state]
    return acts[f, entry[None, :]].T.reshape(-1)[:n]


def starts_of(points: np.ndarray) -> np.ndarray:
    """Whether one of the pattern's matches starts at each code point."""
    n = len(points)
    if n == 0:
        return np.empty(0, bool)
    kinds = classes()[points]
    group = GROUP[kinds]
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = group[1:] != group[:-1]
    ends = np.flatnonzero((group[:-1] == 0) & (group[1:] != 0))  # last blank before a word
    start[ends] = True
    start[ends[kinds[ends] == SPACE] + 1] = False
    if (kinds == APOS).any():
        cut = np.flatnonzero(states(kinds) == CUT)
        two = (kinds[cut] == L_E) | (kinds[cut] == L_L)
        start[np.where(two, cut - 1, cut)] = False
        after = cut + 1
        start[after[after < n]] = True
    return start


class Vocabulary:
    """Ranks of byte strings, with a bounded cache of merged slices."""

    CACHED, GROUP = 600_000, 1 << 20

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for k, v in self.ranks.items():
            self.tokens[v] = k
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.sizes, self.begin = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost of equal ranks."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > 64:
            return self.merge_long(piece)
        get, none = self.ranks.get, len(self.tokens)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap, which keeps long slices near linear."""
        n = len(piece)
        end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        get = self.ranks.get
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] == n or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j], end[i] = False, end[j]
            if end[i] < n:
                prev[end[i]] = i
                if (r := get(piece[i : end[end[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[end[i]]))
            if prev[i] >= 0 and (r := get(piece[prev[i] : end[i]])) is not None:
                heapq.heappush(heap, (r, prev[i], end[i]))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def learn(self, pieces: list[bytes]) -> None:
        merged = [self.merge(p) for p in pieces]
        self.index.update(zip(pieces, range(len(self.index), len(self.index) + len(pieces))))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(merged), np.int32)])
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, merged), np.int64, len(merged))])
        self.begin = np.cumsum(self.sizes) - self.sizes

    def encode_group(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(all ids, ids of each text, byte starts of all slices in their text, ids of each slice, slices of each text)."""
        if len(self.index) > self.CACHED or len(self.flat) > 8 * self.CACHED:
            self.clear()
        joined = "\n".join(texts)
        raw = joined.encode()
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(length + 1) - (length + 1)
        between = (first + length)[:-1]
        if len(raw) == len(joined):
            points, at = np.frombuffer(raw, np.uint8), None
        else:
            points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
            at = np.cumsum(width) - width
        start = starts_of(points)
        start[first[first < len(points)]] = True
        start[between] = True
        places = np.flatnonzero(start)
        own = np.ones(len(points), bool)
        own[between] = False
        own = own[places]
        byte = places if at is None else at[places]
        edges = np.append(byte, len(raw)).tolist()
        pieces = [raw[s:e] for s, e, ok in zip(edges, edges[1:], own.tolist()) if ok]
        row = np.fromiter(map(self.index.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(row < 0).tolist()
        if missing:
            self.learn(list(dict.fromkeys(pieces[i] for i in missing)))
            row[missing] = [self.index[pieces[i]] for i in missing]
        n = self.sizes[row]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(self.begin[row] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        text = np.searchsorted(first, places[own], "right") - 1
        slices = np.bincount(text, minlength=len(texts))
        edge = np.append(0, ends)[np.append(0, np.cumsum(slices))]
        of_text = first if at is None else np.append(at, len(raw))[np.minimum(first, len(points))]
        return ids, np.diff(edge), byte[own] - of_text[text], n, slices

    def encode_all(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, byte starts of slices, ids of each slice) of each text; texts go in groups of about GROUP characters."""
        s = 0
        while s < len(texts):
            e, size = s + 1, len(texts[s])
            while e < len(texts) and size + len(texts[e]) <= self.GROUP:
                size += len(texts[e])
                e += 1
            ids, n, starts, tokens, slices = self.encode_group(texts[s:e])
            a, b = np.append(0, np.cumsum(n)).tolist(), np.append(0, np.cumsum(slices)).tolist()
            for i in range(e - s):
                yield ids[a[i] : a[i + 1]], starts[b[i] : b[i + 1]], tokens[b[i] : b[i + 1]]
            s = e

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(ids, byte starts of slices, ids of each slice)."""
        ids, starts, tokens = next(self.encode_all([text]))
        return ids.tolist(), starts, tokens

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("slice_starts", pa.list_(pa.int64())), ("slice_tokens", pa.list_(pa.int64()))])


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids, and for each slice its byte start and number of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(ranks_path)
        for b in batches:
            rows = list(v.encode_all(b.column(1).to_pylist()))
            yield table({"doc_id": b.column(0), "n_tokens": [len(r[0]) for r in rows], "ids": [r[0] for r in rows], "slice_starts": [r[1] for r in rows], "slice_tokens": [r[2] for r in rows]}, ENCODED)

    small_batches(docs.sparkSession)
    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, slice_starts array<long>, slice_tokens array<long>")


DECODED = pa.schema([("doc_id", pa.int64()), ("bytes", pa.binary())])


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the decoded bytes of each list of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(ranks_path)
        for b in batches:
            yield table({"doc_id": b.column(0), "bytes": [v.decode(x or []) for x in b.column(1).to_pylist()]}, DECODED)

    return encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].alias("ids")).mapInArrow(run, "doc_id long, bytes binary")


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_slices", pa.int64())])


def round_trip(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Digests of ids and of the bytes decoded from them, encoded and decoded in one pass.

    with_ids adds the ids, and byte start and number of ids of each slice.
    """
    lists = [pa.field("ids", pa.list_(pa.int32())), pa.field("slice_starts", pa.list_(pa.int64())), pa.field("slice_tokens", pa.list_(pa.int64()))]
    schema = pa.schema([*DIGEST, *lists]) if with_ids else DIGEST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(ranks_path)
        for b in batches:
            rows = []
            for doc, (ids, starts, tokens) in zip(b.column(0).to_pylist(), v.encode_all(b.column(1).to_pylist()), strict=True):
                row = (doc, len(ids), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), hashlib.sha256(v.decode(ids.tolist())).hexdigest(), len(starts))
                rows.append((*row, ids, starts, tokens) if with_ids else row)
            yield table(dict(zip(schema.names, zip(*rows), strict=True)) if rows else {n: [] for n in schema.names}, schema)

    small_batches(docs.sparkSession)
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_slices long" + ", ids array<int>, slice_starts array<long>, slice_tokens array<long>" * with_ids
    return id_text(docs, id_col, text_col).mapInArrow(run, ddl)
