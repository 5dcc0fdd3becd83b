"""Benchmark decontamination by spaced-seed hashing.

Words are maximal runs of letters, digits and non-ASCII characters, with A-Z lower-cased. Each fixed
mask picks some of its span's neighbouring words and ignores the others, so a seed is equal in two texts
even where an ignored word was replaced. Wherever the words that `share` lets differ stand, some mask
misses them all at some start: shapes() proves this for MASKS by enumeration, and else takes masks that leave
out as many groups of words as words may differ. Seeds of all benchmark items are put in a bit set of fixed
size, which only spares documents' seeds that no item has; documents' seeds that pass are joined with
the items' seeds by hash. Each hit gives a diagonal (place in the text less place in the item), along
which whole words are compared: an overlap counts where at least `share` of `least` neighbouring words
(of the whole item, if it is shorter) are equal. Seeds that over COMMON items share are not paired: all windows around
them are compared by hashes of all words but those that may differ, so rows meet only where an overlap is.

Defined cases: null and empty texts hit nothing; items of fewer than `least` words have masks of their own
length; items without words are never found; repeated rows give one result a
(doc_id, item); null ids are kept as ids; an empty table on either side gives an empty result; texts
are read whole, and an overlap is measured along the whole item, however long; decisions of clean() are for a
doc_id and text, so rows that share a doc_id or have none are judged apart; extra columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warpline.llm.common import NO_ID, buffers, materialise, small_batches, table

#: fixed masks: 1 keeps a word, 0 ignores it
MASKS = ("11101001011", "11011000111", "10110110101", "11110001101", "11111100001", "10010111011")
SPAN, LEAST, SHARE = 11, 13, 0.8
BITS = 27
COMMON = 64  # items that may share a seed before its places are compared by whole windows
LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
FACTOR = np.random.default_rng(20).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def need_of(size: int, least: int, share: float) -> tuple[int, int]:
    """(words in a row, how many of them may differ) of an overlap with an item of `size` words."""
    need = min(least, size)
    return need, need - max(1, math.ceil(share * need - 1e-9))


def covers(masks: tuple[str, ...], need: int, differ: int) -> bool:
    """Whether each placement of `differ` words in `need` leaves a start where some mask meets none of them."""
    kept = [{s + i for i, c in enumerate(m) if c == "1"} for m in masks for s in range(need - len(m) + 1)]
    return all(any(k.isdisjoint(bad) for k in kept) for bad in itertools.combinations(range(need), differ))


@functools.cache
def shapes(need: int, differ: int) -> tuple[str, ...]:
    """Masks that hit every overlap of `need` words of which `differ` are replaced."""
    if need >= LEAST and differ <= 2 and covers(MASKS, need, differ):
        return MASKS
    if not differ:
        return ("1" * need,)
    group = np.arange(need) * min(need, differ + 3) // need
    return tuple("".join("0" if g in out else "1" for g in group) for out in itertools.combinations(range(group[-1] + 1), differ))


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """One hash a start of the mask; masks have hashes of their own."""
    n = len(h) - len(mask) + 1
    out = np.full(max(0, n), xxhash.xxh3_64_intdigest(mask), np.uint64)
    if n > 0:
        for i, keep in enumerate(mask):
            if keep == "1":
                out += h[i : i + n] * FACTOR[i % 63]
        out ^= out >> np.uint64(31)
        out *= FACTOR[63]
        out ^= out >> np.uint64(29)
    return out


def item_texts(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """A row for each item that has words: item_id, ih (hash of its words), item_words (hashes)."""
    schema = pa.schema([("item_id", pa.int64()), ("ih", pa.int64()), ("item_words", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [word_hashes(words_of((t or "").encode())) for t in b.column(1).to_pylist()]
            own = [xxhash.xxh3_64_intdigest(x.tobytes()) for x in h]
            yield table({"item_id": b.column(0), "ih": np.array(own, np.uint64).view(np.int64), "item_words": [x.view(np.int64) for x in h]}, schema)

    rows = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id long, ih long, item_words array<long>").filter(F.size("item_words") > 0)


def item_seeds(texts: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """A row for each seed of texts (ih, item_words): ih, size, span (of its mask), hash, at. Linear in an item's length."""
    schema = pa.schema([("ih", pa.int64()), ("size", pa.int32()), ("span", pa.int32()), ("hash", pa.int64()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, ih in enumerate(b.column(0).to_pylist()):
                h = b.column(1)[i].values.to_numpy().view(np.uint64)
                for mask in shapes(*need_of(len(h), least, share)):
                    got = seeds(h, mask)
                    yield table({"ih": np.full(len(got), ih), "size": np.full(len(got), len(h), np.int32), "span": np.full(len(got), len(mask), np.int32), "hash": got.view(np.int64), "at": np.arange(len(got), dtype=np.int32)}, schema)

    return texts.select("ih", "item_words").mapInArrow(run, "ih long, size int, span int, hash long, at int")


def _bits_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << BITS) - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)


def bit_set(items: DataFrame) -> np.ndarray:
    """2**BITS bits (16 MB, whatever the benchmark's size) with two of them set for each seed."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.asarray(b.column(0)).view(np.uint64)
            at = np.unique(np.concatenate(_bits_of(h)))
            yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int32)), pa.array((at & 63).astype(np.int32))], names=["word", "bit"])

    words = items.select("hash").mapInArrow(places, "word int, bit int").groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    out = np.zeros(1 << (BITS - 6), np.int64)
    got = words.toArrow()  # a row for each 64 bits that are set at all, so 2**(BITS - 6) at most
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out.view(np.uint8)


REGIONS = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("words", pa.list_(pa.int64())), ("hits", pa.list_(pa.int64())), ("places", pa.list_(pa.int64()))])


def regions(docs: DataFrame, bits: np.ndarray, masks: list[str], context: int, id_col: str, text_col: str) -> DataFrame:
    """Stretches of documents around seeds that pass the bit set: word hashes, seed hashes and their places.

    A stretch has `context` words on both sides of its seeds; those that would overlap are one, so
    a document's stretches together are no longer than it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = sent.value
        for b in batches:
            raw, off = buffers(b.column(2))
            data = raw.tobytes()
            cols: dict[str, list] = {n: [] for n in REGIONS.names}
            split = [words_of(data[s:e]) for s, e in zip(off[:-1].tolist(), off[1:].tolist())]
            edge = np.cumsum([0, *map(len, split)])
            h = word_hashes([w for s in split for w in s])
            at_all, hash_all, size_all = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for size, made in ((len(m), seeds(h, m)) for m in masks):
                x, y = _bits_of(made)
                ok = np.flatnonzero((filter_[x >> 3] >> (x & 7).astype(np.uint8)) & (filter_[y >> 3] >> (y & 7).astype(np.uint8)) & 1)
                at_all.append(ok)
                hash_all.append(made[ok])
                size_all.append(np.full(len(ok), size))
            at, hashes, size = np.concatenate(at_all), np.concatenate(hash_all), np.concatenate(size_all)
            doc = np.searchsorted(edge, at, "right") - 1
            inside = at + size <= edge[doc + 1]
            order = np.argsort(at[inside], kind="stable")
            at, hashes, doc = at[inside][order], hashes[inside][order], doc[inside][order]
            i, n = 0, len(at)
            while i < n:
                j = i + 1
                while j < n and doc[j] == doc[i] and at[j] - at[j - 1] <= 2 * context:
                    j += 1
                low = max(int(edge[doc[i]]), int(at[i]) - context)
                high = min(int(edge[doc[i] + 1]), int(at[j - 1]) + context)
                row = (b.column(0)[int(doc[i])].as_py(), b.column(1)[int(doc[i])].as_py(), low - int(edge[doc[i]]), h[low:high].view(np.int64), hashes[i:j].view(np.int64), at[i:j] - low)
                for name, v in zip(REGIONS.names, row, strict=True):
                    cols[name].append(v)
                i = j
            yield table(cols, REGIONS)

    small_batches(docs.sparkSession)
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return own.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, start long, words array<long>, hits array<long>, places array<long>")


@functools.cache
def full_masks(need: int, differ: int) -> tuple[str, ...]:
    """All ways to leave out as many words of a window as may differ: windows with one such hash in common overlap enough."""
    return tuple("".join("0" if i in out else "1" for i in range(need)) for out in map(set, itertools.combinations(range(need), differ)))


def window_hashes(windows: DataFrame, need: int, differ: int, bits: np.ndarray | None = None) -> DataFrame:
    """Rows (words, other columns) of windows of `need` words, once for each full mask, with the hash `full` in the words' place; only hashes in bits."""
    keep = [c for c in windows.columns if c != "words"]
    schema = pa.schema([pa.field(c, pa.int64()) for c in [*keep, "full"]])
    sent = None if bits is None else windows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.asarray(b.column(len(keep)).flatten()).view(np.uint64)
            for mask in full_masks(need, differ):  # windows lie one after another: every need-th start of the mask is a window
                got = seeds(h, mask)[::need]
                rows = pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(got.view(np.int64))], schema=schema)
                if sent is not None:
                    x, y = _bits_of(got)
                    rows = rows.filter(pa.array(((sent.value[x >> 3] >> (x & 7).astype(np.uint8)) & (sent.value[y >> 3] >> (y & 7).astype(np.uint8)) & 1).astype(bool)))
                yield rows

    return windows.select(*[F.col(c).cast("long").alias(c) for c in keep], "words").mapInArrow(run, ", ".join(f"{c} long" for c in [*keep, "full"]))


def common_windows(seed: DataFrame, hits: DataFrame, found: DataFrame, texts: DataFrame, share: float) -> list[tuple[DataFrame, DataFrame]]:
    """[(windows of texts, windows of items)] with hashes `full`, for seeds (hash, need, ...) that many items hold, such as a task's header.

    Nearly all places of such a seed are no overlap with nearly all of its items, so they aren't paired. Around each of them, in items and in
    texts, all windows of `need` words are taken that can hold the seed there; an overlap is a pair of
    windows with a full mask's hash in common, so rows meet for overlaps only, and for all of them.
    """
    spots = F.sequence(F.col("place") - (F.col("need") - F.col("span")), F.col("place"))
    part = F.slice("words", (F.col("w") + 1).cast("int"), F.col("need"))
    inside = (F.col("w") >= 0) & (F.col("w") + F.col("need") <= F.size("words"))
    own = seed.select("ih", "size", "need", "span", F.col("at").cast("long").alias("place")).select("ih", "size", "need", F.explode(spots).alias("w")).distinct()
    own = own.join(texts.select("ih", F.col("item_words").alias("words")), "ih").filter(inside).select("ih", "size", "need", F.col("w").alias("at"), part.alias("words"))
    places = hits.join(seed.select("hash", "need", "span").distinct(), "hash").select("key", "th", "start", "need", F.explode(spots).alias("w")).distinct()
    places = places.join(found.select("key", "th", "start", "words"), ["key", "th", "start"]).filter(inside).select("key", "th", "start", "need", "w", part.alias("words"))
    out = []
    for need in [r["need"] for r in seed.select("need").distinct().collect()]:  # `least` at most
        differ = need - max(1, math.ceil(share * need - 1e-9))
        a = materialise(window_hashes(own.filter(F.col("need") == need).drop("need"), need, differ))
        out.append((window_hashes(places.filter(F.col("need") == need).drop("need"), need, differ, bit_set(a.select(F.col("full").alias("hash")))), a))
    return out


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int, least: int, share: float) -> tuple[int, int, int] | None:
    """(first word, end, equal words) of what overlaps along a diagonal; None if it is too little."""
    low, high = max(0, diagonal), min(len(doc), diagonal + len(item))
    need = min(least, len(item))
    if high - low < need:
        return None
    equal = np.concatenate([[0], np.cumsum(doc[low:high] == item[low - diagonal : high - diagonal])])
    good = np.flatnonzero(equal[need:] - equal[:-need] >= int(np.ceil(share * need - 1e-9)))
    if not len(good):
        return None
    s, e = int(good[0]), int(good[-1]) + need
    return low + s, low + e, int(equal[e] - equal[s])


FOUND = pa.schema([("key", pa.int64()), ("th", pa.int64()), ("ih", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("n_equal", pa.int64())])


class _Sought(NamedTuple):
    """Items and texts of a search: seeds that few items hold and those that many do, hits (hash, place) in stretches of texts."""

    items: DataFrame
    texts: DataFrame
    few: DataFrame
    many: DataFrame | None
    hits: DataFrame
    found: DataFrame


def _sought(docs: DataFrame, benchmark: DataFrame, least: int, share: float, id_col: str, text_col: str) -> _Sought:
    items = materialise(item_texts(benchmark))
    texts = items.dropDuplicates(["ih"]).select("ih", "item_words")  # equal items are sought once
    seed = materialise(item_seeds(texts, least, share).withColumn("need", F.least("size", F.lit(least))))
    sizes = [r["need"] for r in seed.select("need").distinct().collect()]  # `least` at most
    masks = sorted({m for n in sizes for m in shapes(*need_of(n, least, share))})
    longest = seed.agg(F.max("size")).first()[0] or 1
    found = materialise(regions(docs, bit_set(seed), masks, longest, id_col, text_col)).dropDuplicates(["doc_id", "th", "start"])
    found = found.withColumn("key", F.coalesce("doc_id", F.lit(NO_ID)))
    hits = found.select("key", "th", "start", F.explode(F.arrays_zip("hits", "places")).alias("z")).select("key", "th", "start", F.col("z.hits").alias("hash"), F.col("z.places").alias("place"))
    often = materialise(seed.groupBy("hash", "need").agg(F.count_distinct("ih").alias("items")).filter(F.col("items") > COMMON).select("hash", "need"))
    if often.isEmpty():
        return _Sought(items, texts, seed, None, hits, found)
    return _Sought(items, texts, seed.join(often, ["hash", "need"], "left_anti"), materialise(seed.join(often, ["hash", "need"])), hits, found)


def _overlaps(s: _Sought, pairs: DataFrame, least: int, share: float) -> DataFrame:
    """(key, th, ih, first_word, n_words, n_equal) of pairs (key, th, start, ih, size, diagonal) that overlap enough."""
    found, texts = s.found, s.texts
    low = F.greatest(F.col("diagonal"), F.lit(0))
    part = F.slice("words", (low + 1).cast("int"), (F.col("diagonal") + F.col("size") - low).cast("int"))  # what lies beside the item
    beside = pairs.join(found.select("key", "th", "start", "words"), ["key", "th", "start"]).select("key", "th", "ih", (F.col("start") + low).alias("first"), (low - F.col("diagonal")).cast("int").alias("skip"), part.alias("part"))
    both = beside.join(texts, "ih").select("key", "th", "ih", "first", "skip", "part", "item_words")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            words, item_words = b.column(5), b.column(6)
            for i, (key, th, ih, first, skip) in enumerate(zip(*(b.column(k).to_pylist() for k in range(5)), strict=True)):
                got = overlap(words[i].values.to_numpy(), item_words[i].values.to_numpy(), -skip, least, share)
                if got:
                    rows.append((key, th, ih, first + got[0], got[1] - got[0], got[2]))
            yield table(dict(zip(FOUND.names, zip(*rows), strict=True)) if rows else {n: [] for n in FOUND.names}, FOUND)

    return both.mapInArrow(verify, "key long, th long, ih long, first_word long, n_words long, n_equal long")


def _few(s: _Sought) -> DataFrame:
    return s.hits.join(s.few, "hash").select("key", "th", "start", "ih", "size", (F.col("place") - F.col("at")).cast("long").alias("diagonal"))


def located(docs: DataFrame, benchmark: DataFrame, *, least: int = LEAST, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and item that it holds: doc_id, th (tells texts of one doc_id apart), item_id, place and size."""
    s = _sought(docs, benchmark, least, share, id_col, text_col)
    pairs = _few(s)
    for b, a in common_windows(s.many, s.hits, s.found, s.texts, share) if s.many is not None else []:
        pairs = pairs.unionByName(b.join(a, "full").select("key", "th", "start", "ih", F.col("size").cast("int").alias("size"), (F.col("w") - F.col("at")).alias("diagonal")))
    done = _overlaps(s, pairs.distinct(), least, share)
    items = s.items
    best = F.max_by(F.struct("first_word", "n_words", "n_equal"), F.struct("n_equal", "n_words", -F.col("first_word"))).alias("b")
    one = done.groupBy("key", "th", "ih").agg(best)
    ids = items.select("ih", "item_id").distinct()
    return one.join(ids, "ih").select(F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id"), "key", "th", "item_id", "b.first_word", "b.n_words", "b.n_equal")


def matches(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """A row for each document and benchmark item that it holds: doc_id, item_id, first_word, n_words, n_equal."""
    best = F.max_by(F.struct("first_word", "n_words", "n_equal"), F.struct("n_equal", "n_words", -F.col("first_word")))
    return located(docs, benchmark, **options).groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.first_word", "b.n_words", "b.n_equal")


def leaks(docs: DataFrame, benchmark: DataFrame, *, least: int = LEAST, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, th) of texts that hold any item. What many items have in common is looked up once, not once an item."""
    s = _sought(docs, benchmark, least, share, id_col, text_col)
    out = _overlaps(s, _few(s).distinct(), least, share).select("key", "th")
    for b, a in common_windows(s.many, s.hits, s.found, s.texts, share) if s.many is not None else []:
        out = out.unionByName(b.join(a.select("full").distinct(), "full", "left_semi").select("key", "th"))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """docs without the rows whose text holds a benchmark item; all columns stay."""
    found = materialise(leaks(docs, benchmark, **options).select(F.col("key").alias("__key"), F.col("th").alias("__th")).distinct())
    key, th = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.join(found, (key == found["__key"]) & (th == found["__th"]), "left_anti")
