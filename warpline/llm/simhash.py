"""SimHash near-dedup: fingerprints of word shingles, linked within a Hamming radius by BK-trees.

Two fingerprints within `radius` bits agree wholly in one of radius + 1 blocks of bits, so each
distinct fingerprint goes to radius + 1 shards, one a block value. A shard builds a BK-tree (children
keyed by the distance to their parent) and each of its fingerprints follows only edges whose
distance is within the radius of its own. A shard of more than SHARD fingerprints is split anew by
blocks of its remaining bits, until all are small: exact, with no cap on partners. A shard answers with
a spanning forest of its links, which keeps every link's connection without listing pairs. Components
of fingerprints come from star rounds; documents with the same fingerprint never meet in one task.

Defined cases: a null, empty or blank text has fingerprint zero and links like any other; texts of
fewer words than a shingle are one shingle; ties of a bit (set in exactly half) are 0; repeated rows
have one component; null doc_ids keep a row, and count in no component but their fingerprint's; an
empty table gives an empty result; extra columns are not read; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warpline.llm.common import LAST_ID, buffers, id_text, materialise, partitions, remove, small_batches, table
from warpline.llm.components import components

SHARD = 1024
PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """64 bits, each set if more than half of the shingles' XXH64 have it."""
    words = text.lower().split()  # bytes: lowers A-Z and splits at 0x20 and 0x09 to 0x0D only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), len(words) - k + 1
    s, e = starts[:n].tolist(), ends[k - 1 :].tolist()
    for at in range(0, n, 65536):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(s[at : at + 65536], e[at : at + 65536])], "<u8")
        total += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = buffers(b.column(1))
            data, edges = raw.tobytes(), off.tolist()
            fp = np.array([fingerprint(data[s:e], shingle) for s, e in zip(edges, edges[1:])], np.uint64)
            yield table({"doc_id": b.column(0), "fp": fp.view(np.int64)}, PRINTS)

    small_batches(docs.sparkSession)
    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints of one word each, or of rows of words."""
    d = np.bitwise_count(a ^ b)
    return d.astype(np.int64) if d.ndim == 1 else d.sum(axis=1, dtype=np.int64)


class BKTree:
    """BK-tree over fingerprints (words, or rows of words), built and searched a level at a time."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        self.most = 64 * (fps.shape[1] if fps.ndim > 1 else 1)
        fan = self.most + 1
        n = len(fps)
        waiting, parent = np.arange(1, n), np.zeros(max(0, n - 1), np.int64)
        keys, children = [], []
        while len(waiting):
            key = parent * fan + distance(fps[waiting], fps[parent])
            edge, first, which = np.unique(key, return_index=True, return_inverse=True)
            keys.append(edge)
            children.append(waiting[first])
            rest = np.ones(len(waiting), bool)
            rest[first] = False
            parent = waiting[first][which][rest]
            waiting = waiting[rest]
        key = np.concatenate(keys) if keys else np.empty(0, np.int64)
        order = np.argsort(key)
        self.edge, self.child = key[order], (np.concatenate(children) if children else np.empty(0, np.int64))[order]

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) index pairs within the radius."""
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(q):
            d = distance(queries[q], self.fps[node])
            hit = d <= radius
            found.append((q[hit], node[hit]))
            low = np.searchsorted(self.edge, node * (self.most + 1) + np.maximum(d - radius, 0))
            high = np.searchsorted(self.edge, node * (self.most + 1) + np.minimum(d + radius, self.most), "right")
            n = high - low
            ends = np.cumsum(n)
            at = np.repeat(low - (ends - n), n) + np.arange(int(n.sum()))
            q, node = np.repeat(q, n), self.child[at]
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def forest(fps: np.ndarray, radius: int, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of a shard as (member, root): the members of a root are those its links connect.

    With `first`, only links between the first so many fingerprints and the others count.
    """
    tree, label = BKTree(fps[:first]), np.arange(len(fps))
    for s in range(first or 0, len(fps), 512):
        q, b = tree.search(fps[s : s + 512], radius)
        a, b = label[q + s], label[b]
        a, b = np.concatenate([a[a != b], b[a != b]]), np.concatenate([b[a != b], a[a != b]])
        while len(a):
            before = label.copy()
            np.minimum.at(label, a, label[b])
            label = label[label]
            if (label == before).all():
                break
    member = np.flatnonzero(label != np.arange(len(fps)))
    return member, label[member]


def _split(mask: int, blocks: int) -> list[int]:
    """Masks that add one block each of the bits that mask leaves."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in part.tolist()) for part in np.array_split(free, blocks) if len(part)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp`, a spanning forest of each shard's links."""
    spark = distinct.sparkSession
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        key = None

        def done() -> pa.RecordBatch:
            fps = np.unique(np.concatenate(held)).view(np.uint64)
            m, r = forest(fps, radius)
            return table({"a": fps[m].view(np.int64), "b": fps[r].view(np.int64)}, schema)

        for batch in batches:
            masks, values, fps = (np.asarray(batch.column(i)) for i in range(3))
            cut = np.flatnonzero((masks[1:] != masks[:-1]) | (values[1:] != values[:-1])) + 1
            edges = [0, *cut.tolist(), len(fps)]
            for s, e in zip(edges, edges[1:]):
                if s == e:
                    continue
                if (masks[s], values[s]) != key:
                    if sum(map(len, held)) > 1:
                        yield done()
                    held, key = [], (masks[s], values[s])
                held.append(fps[s:e])
        if sum(map(len, held)) > 1:
            yield done()

    masks = [0]
    rows = distinct.select("fp", F.lit(0).cast("long").alias("mask"))
    out = None
    while True:
        wider = {m: [_signed(x) for x in _split(m & (2**64 - 1), radius + 1)] for m in masks}
        cases = F.array(*[F.lit(x) for x in next(iter(wider.values()))]) if len(wider) == 1 else F.create_map(*[y for m, xs in wider.items() for y in (F.lit(_signed(m)), F.array(*map(F.lit, xs)))])[F.col("mask")]
        rows = rows.select("fp", F.explode(cases).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "value").agg(F.count("*").alias("size")).filter("size > 1")
        sizes = materialise(sizes)
        hot = materialise(sizes.filter(F.col("size") > SHARD).select("mask", "value"))
        masks = [m & (2**64 - 1) for m in sorted({r["mask"] for r in hot.select("mask").distinct().collect()})]  # as many as masks exist
        small = rows if not masks else rows.join(hot, ["mask", "value"], "left_anti")
        found = small.select("mask", "value", "fp").repartition(partitions(spark), "mask", "value").sortWithinPartitions("mask", "value").mapInArrow(search, "a long, b long")
        found = materialise(found)
        out = found if out is None else out.unionByName(found)
        if not masks:
            return out.distinct()
        rows = materialise(rows.join(hot, ["mask", "value"]).select("fp", "mask"))


def near_duplicates(docs: DataFrame, *, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex), component_id: smallest doc_id reachable over links."""
    prints = materialise(fingerprints(docs, shingle, id_col, text_col))
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    nodes = components(links(classes, radius))
    # the smallest doc_id of a component of fingerprints
    of = materialise(nodes.join(classes, nodes["node"] == classes["fp"]).select("fp", "component", "least"))
    least = of.groupBy("component").agg(F.min("least").alias("low"))
    joined = materialise(of.join(least, "component").select("fp", "low"))
    labels = materialise(classes.join(joined, "fp", "left").select("fp", F.coalesce("low", "least").alias("component_id")))
    return prints.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# near copies by similarity ---------------------------------------------------------------------------

#: words of a wide fingerprint; members a shard should have; recall of the shards for a pair at the similarity
#: wanted; standard deviations that the radius leaves room for
WIDE, ROOM, RECALL, DEVIATIONS = 4, 256, 0.995, 3.0
HEAVY = 1 << 21  # shingles of a chunk whose members bring their sets


def radius_of(similarity: float, words: int = WIDE) -> int:
    """Bits within which texts of this Jaccard similarity lie but for DEVIATIONS standard deviations."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    n = 64 * words
    return int(share * n + DEVIATIONS * np.sqrt(share * (1 - share) * n))


def shingle_hashes(text: bytes, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    n = len(words) - k + 1
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist())), np.uint64, n))


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """WIDE words: each bit set if more than half of the distinct shingles' hashes have it."""
    total = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(h), 16384):
        part = np.repeat(h[at : at + 16384, None], WIDE, axis=1)
        for i in range(WIDE):
            x = part[:, i]
            x += OFFSETS[i]
            x ^= x >> np.uint64(30)
            x *= MORE
            x ^= x >> np.uint64(27)
        total += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(h), bitorder="little").view("<u8")


MORE = np.uint64(0xBF58476D1CE4E5B9)
OFFSETS = np.array([i * 0x9E3779B97F4A7C15 % 2**64 for i in range(WIDE)], np.uint64)
COLUMNS = [f"f{i}" for i in range(WIDE)]
PRINT_DDL = ", ".join(f"{c} long" for c in COLUMNS)


def wide_fingerprints(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (tells texts of one doc_id apart), id (hash of the set of shingles), n (its size), f0, f1, ..."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "th", "id", "n", *COLUMNS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = buffers(b.column(2))
            data, edges = raw.tobytes(), off.tolist()
            sets = [shingle_hashes(data[s:e], shingle) for s, e in zip(edges, edges[1:])]
            fp = np.array([wide_fingerprint(h) for h in sets], np.uint64).reshape(-1, WIDE).view(np.int64)
            own = np.array([xxhash.xxh3_64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
            yield table({"doc_id": b.column(0), "th": b.column(1), "id": own, "n": [len(h) for h in sets], **{c: fp[:, i] for i, c in enumerate(COLUMNS)}}, schema)

    small_batches(docs.sparkSession)
    return id_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, id long, n long, " + PRINT_DDL)


def tables_for(n: int, similarity: float) -> list[np.ndarray]:
    """Sampled bit places, a table each: shards of about ROOM members, and as many tables as RECALL needs.

    Bits and tables grow with the logarithm of the rows; the recall of a pair is the same at every size.
    """
    bits = int(np.clip(np.ceil(np.log2(max(n, 2) / ROOM)), 8, 30))
    agree = (1 - np.arccos(2 * similarity / (1 + similarity)) / np.pi) ** bits
    count = int(np.ceil(np.log(1 - RECALL) / np.log(1 - agree)))
    rng = np.random.default_rng(11)
    return [rng.choice(64 * WIDE, bits, replace=False) for _ in range(count)]


def spanning(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indexes of edges (a, b) that connect the labels as all of them do, without cycles; new labels).

    Boruvka rounds: each label takes its first edge to another one.
    """
    label, taken = label.copy(), []
    live = np.arange(len(a))
    while len(live := live[label[a[live]] != label[b[live]]]):
        ends = np.concatenate([label[a[live]], label[b[live]]])
        first_of = np.full(int(label.max()) + 1, len(a))
        np.minimum.at(first_of, ends, np.concatenate([live, live]))
        first = np.unique(first_of[first_of < len(a)])
        taken.append(first)
        x, y = label[a[first]], label[b[first]]
        new = np.arange(len(first_of))
        while True:
            before = new.copy()
            np.minimum.at(new, x, new[y])
            np.minimum.at(new, y, new[x])
            new = new[new]
            if (new == before).all():
                break
        label = new[label]
    return (np.concatenate(taken) if taken else np.empty(0, np.int64)), label


def candidates(fps: np.ndarray, size: np.ndarray, label: np.ndarray, radius: int, similarity: float, first: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b), a < b, of a shard's members within the radius that have different labels, in parts.

    Pairs whose set sizes rule the similarity out are none. With `first`, only pairs between the first so many
    members and the others count.
    """
    m = len(fps)
    tree = BKTree(fps[:first])
    for s in range(first or 0, m, 512):
        q, node = tree.search(fps[s : s + 512], radius)
        x, y = np.minimum(q + s, node), np.maximum(q + s, node)
        ok = (label[x] != label[y]) & (np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]) - 1e-9)
        code = np.unique(x[ok] * m + y[ok])
        yield code // m, code % m


def in_shards(rows: DataFrame, work: Callable[[int, dict[str, np.ndarray], int | None], dict], schema: pa.Schema, ddl: str, weight: Column | None = None) -> DataFrame:
    """work(key, columns, first) for the members of each shard of rows (key, id, n, label, f0, ...).

    A shard of more than 4 * SHARD members, or of a weight beyond HEAVY, is dealt in chunks, and each chunk meets
    each other one, with all members, in a task of its own: no pair of a shard is lost. first is the size
    of the first of two chunks; None: one chunk, all pairs.
    """
    names = [c for c in rows.columns if c != "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def done() -> pa.RecordBatch:
            t, first = pa.Table.from_batches(held), None
            own = t["own"].to_numpy()
            if now[1] != now[2]:  # two chunks: pairs inside each are another task's
                order = np.argsort(own, kind="stable")
                t, first = t.take(pa.array(order)), int((own == now[1]).sum())
            cols = {c: t[c].combine_chunks() if pa.types.is_list(t[c].type) else t[c].to_numpy() for c in names}
            return table(work(now[0], cols, first), schema)

        for b in batches:
            key, low, high = (np.asarray(b.column(i)) for i in range(3))
            cut = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1).tolist(), len(key)]
            for s, e in zip(cut, cut[1:]):
                if s == e:
                    continue
                if held and (key[s], low[s], high[s]) != now:
                    yield done()
                    held = []
                now = (int(key[s]), int(low[s]), int(high[s]))
                held.append(b.slice(s, e - s))
        if held:
            yield done()

    sizes = materialise(rows.groupBy("key").agg(F.count("*").alias("m"), F.sum(F.lit(0) if weight is None else weight).alias("w")).filter("m > 1"))
    chunks = F.ceil(F.greatest(F.col("m") / (4 * SHARD), F.col("w") / HEAVY))
    dealt = rows.join(sizes, "key").withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    pairs = met.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", *names)
    by = ["key", "low", "high"]
    return materialise(pairs.repartition(partitions(rows.sparkSession), *by).sortWithinPartitions(*by, "id").mapInArrow(run, ddl))


def dealt(classes: DataFrame, places: list[np.ndarray]) -> DataFrame:
    """classes (id, n, label, f0, ...) with the key of each table's shard: a row a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.stack([np.asarray(b.column(3 + i)) for i in range(WIDE)], axis=1)
            on = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")
            for t, where in enumerate(places):
                key = on[:, where].astype(np.int64) @ (1 << np.arange(len(where), dtype=np.int64)) | t << 32
                yield pa.RecordBatch.from_arrays([pa.array(key), *b.columns], names=["key", *b.schema.names])

    has = lambda name, other: F.col(name) if name in classes.columns else other
    own = classes.select("id", has("n", F.lit(1)).cast("long").alias("n"), has("label", F.col("id")).alias("label"), *COLUMNS)
    return own.mapInArrow(run, f"key long, id long, n long, label long, {PRINT_DDL}")


def _members(cols: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, labels numbered from 0) of a shard."""
    return np.stack([cols[c] for c in COLUMNS], axis=1).view(np.uint64), np.unique(cols["label"], return_inverse=True)[1]


LINKS = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def similar_links(classes: DataFrame, similarity: float, places: list[np.ndarray] | None = None) -> DataFrame:
    """(key, a, b): in each shard a spanning forest of candidate links between ids of classes (id, f0, ...)."""
    radius = radius_of(similarity)

    def work(key: int, cols: dict[str, np.ndarray], first: int | None) -> dict:
        fps, now = _members(cols)
        label, found = now, []
        for a, b in candidates(fps, cols["n"], label, radius, similarity, first):
            open_ = now[a] != now[b]  # what a part connects need not be connected again
            a, b = a[open_], b[open_]
            chosen, now = spanning(now, a, b)
            found.append((a[chosen], b[chosen]))
        a, b = (cols["id"][np.concatenate(x)] if found else np.empty(0, np.int64) for x in (list(zip(*found)) or [[], []]))
        return {"key": np.full(len(a), key), "a": np.minimum(a, b), "b": np.maximum(a, b)}

    return in_shards(dealt(classes, tables_for(classes.count(), similarity) if places is None else places), work, LINKS, "key long, a long, b long")


def open_members(classes: DataFrame, keys: DataFrame, similarity: float, places: list[np.ndarray]) -> DataFrame:
    """(key, id): members of the shards in keys that are within the radius of one with another label."""
    radius, schema = radius_of(similarity), pa.schema([("key", pa.int64()), ("id", pa.int64())])

    def work(key: int, cols: dict[str, np.ndarray], first: int | None) -> dict:
        fps, label = _members(cols)
        found = [np.unique(np.concatenate(ab)) for ab in candidates(fps, cols["n"], label, radius, similarity, first)]
        ids = cols["id"][np.unique(np.concatenate(found))] if found else np.empty(0, np.int64)
        return {"key": np.full(len(ids), key), "id": ids}

    rows = dealt(classes, places).join(keys, "key", "left_semi")
    return in_shards(rows, work, schema, "key long, id long").distinct()


def linked(sets: list[np.ndarray], label: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of sets those that have the similarity and connect what was not connected before."""
    label, size = label.copy(), np.array([len(x) for x in sets], np.int64)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.cumsum(size) - size
    mark = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)
    out: list[tuple[int, int]] = []
    for a, b in pairs:
        edge = [0, *(np.flatnonzero(a[1:] != a[:-1]) + 1).tolist(), len(a)]
        for s, e in zip(edge, edge[1:]):
            if s == e:
                continue
            q = int(a[s])
            others = b[s:e]
            others = others[(label[others] != label[q]) & (size[others] > 0)]
            if not len(others) or not size[q]:
                continue
            mine = flat[start[q] : start[q] + size[q]]
            mark[mine] = True
            n = size[others]
            ends = np.cumsum(n)
            at = np.repeat(start[others] - (ends - n), n) + np.arange(int(ends[-1]))
            both = np.add.reduceat(mark[flat[at]].astype(np.int64), ends - n)
            mark[mine] = False
            for o in others[both >= similarity * (size[q] + n - both) - 1e-9].tolist():
                if label[o] != label[q]:
                    out.append((q, o))
                    label[label == label[o]] = label[q]
    found = np.array(out, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def settled_links(members: DataFrame, similarity: float) -> DataFrame:
    """(key, a, b): links between members (key, id, n, label, f0, ..., hashes) of a shard, verified on the sets of
    hashes there and then: all candidates are looked at, and those that connect anything new are passed on."""
    radius = radius_of(similarity)

    def work(key: int, cols: dict[str, np.ndarray], first: int | None) -> dict:
        fps, label = _members(cols)
        lists = cols["hashes"]
        flat, off = lists.flatten().to_numpy(), (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
        sets = [flat[s:e] for s, e in zip(off, off[1:])]
        a, b = linked(sets, label, candidates(fps, cols["n"], label, radius, similarity, first), similarity)
        a, b = cols["id"][a], cols["id"][b]
        return {"key": np.full(len(a), key), "a": np.minimum(a, b), "b": np.maximum(a, b)}

    return in_shards(members, work, LINKS, "key long, a long, b long", weight=F.col("n"))


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b, ok) of pairs: ok if the sets of shingles of texts (id, text) have this Jaccard similarity or more."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ok", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, last, x = [], None, None
            for own, t, u in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if own != last:  # pairs of one text tend to follow one another
                    last, x = own, shingle_hashes(t.encode(), shingle)
                y = shingle_hashes(u.encode(), shingle)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield table({"a": b.column(0), "b": b.column(1), "ok": ok}, schema)

    small_batches(pairs.sparkSession)
    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("t")), texts.select(F.col("id").alias("b"), F.col("text").alias("u"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "t", "u").mapInArrow(run, "a long, b long, ok boolean")


def _or_last(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(LAST_ID))


def similar_classes(docs: DataFrame, classes: DataFrame, *, shingle: int, similarity: float) -> DataFrame:
    """(node, component) of classes (id, n, rep of doc_id and th, f0...) under verified links.

    Shards first name links that would connect their members as all candidates do; these are verified on
    whole texts. Only a shard with a refused link can hold more: its members that still have a candidate with
    another label bring their sets of shingles there, and all their candidates are verified in the shard,
    which passes on no more than what connects them. So every candidate either is verified or lies within
    one component, and neither copies nor candidates are expanded to rows.
    """
    own = docs.select(_or_last(F.col("doc_id")).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("th"), "text")
    reps = classes.select("id", "rep.doc_id", "rep.th")
    texts_of = lambda ids: own.join(reps.join(ids, "id"), ["doc_id", "th"]).select("id", "text").dropDuplicates(["id"])
    places = tables_for(classes.count(), similarity)
    pairs = similar_links(classes, similarity, places)
    new = materialise(pairs.select("a", "b").distinct())
    texts = materialise(texts_of(new.select(F.col("a").alias("id")).union(new.select("b")).distinct()))
    checked = materialise(verified(new, texts, shingle, similarity))
    remove(new, texts)
    good, refused = checked.filter("ok").select("a", "b"), checked.filter("not ok").select("a", "b")
    if refused.isEmpty():
        return components(good)
    keys = materialise(pairs.join(refused, ["a", "b"], "left_semi").select("key").distinct())
    labels = components(good).select(F.col("node").alias("id"), F.col("component").alias("label"))
    now = materialise(classes.join(labels, "id", "left").select("id", "n", F.coalesce("label", "id").alias("label"), *COLUMNS))
    members = materialise(open_members(now, keys, similarity, places))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield table({"id": b.column(0), "hashes": [shingle_hashes(t.encode(), shingle).view(np.int64) for t in b.column(1).to_pylist()]}, pa.schema([("id", pa.int64()), ("hashes", pa.list_(pa.int64()))]))

    sets = materialise(texts_of(members.select("id").distinct()).mapInArrow(hashed, "id long, hashes array<long>"))
    more = settled_links(members.join(now, "id").join(sets, "id").select("key", "id", "n", "label", *COLUMNS, "hashes"), similarity)
    return components(good.unionByName(more.select("a", "b")))


def keep_one_similar(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of docs of each group of near copies: that of the smallest doc_id, then text hash; rows without a doc_id come after all others.

    Near copies are texts whose sets of word shingles have this Jaccard similarity or more, or a chain
    of such texts. BK-trees find candidates; each link is verified on the sets. Texts of equal sets are always
    near copies; rows that share doc_id and text count once; rows that share a doc_id are judged apart.
    """
    names = docs.columns
    prints = materialise(wide_fingerprints(docs, shingle).withColumn("doc_id", _or_last(F.col("doc_id"))))
    classes = materialise(prints.groupBy("id", "n", *COLUMNS).agg(F.min(F.struct("doc_id", "th")).alias("rep")))
    nodes = similar_classes(docs, classes, shingle=shingle, similarity=similarity)
    whole = classes.select("id", "rep").join(nodes.withColumnRenamed("node", "id"), "id", "left").withColumn("group", F.coalesce("component", "id"))
    least = whole.groupBy("group").agg(F.min("rep").alias("least"))
    firsts = whole.join(least, "group").select("id", "least")
    rows = prints.groupBy("id", "doc_id", "th").agg(F.count("*").alias("copies")).join(firsts, "id")
    judged = materialise(rows.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "copies", (F.struct("doc_id", "th") == F.col("least")).alias("first")).filter("copies > 1 or not first"))
    mark = "_" * (1 + max(map(len, names)))  # longer than any name of docs
    own = docs.withColumn(mark, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    same = lambda t: (_or_last(own["doc_id"]) == t["__id"]) & (own[mark] == t["__th"])
    kept = own.join(judged, same(judged), "left_anti")
    again = judged.filter("first")
    if not again.isEmpty():
        kept = kept.unionByName(own.join(again, same(again), "left_semi").dropDuplicates(["doc_id", mark]))
    return kept.select(*[f"`{c}`" for c in names])


def keep_one(docs: DataFrame, *, shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; rows with a null doc_id stay."""
    names = docs.columns
    found = near_duplicates(docs, shingle=shingle, radius=radius)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti").select(*names)
