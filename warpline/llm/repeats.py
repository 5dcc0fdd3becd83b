"""Repeated windows across a corpus: the frame that suffix-array and substring dedup share.

1. Each text's windows are grouped in anchored runs (anchors.py); a run is a row of keys, no text.
2. Anchors met once hold no repeat and go. Runs of the same content collapse to one with a count.
3. Runs whose anchor has several contents are undecided; one text slice each is dealt by anchor to
   shards, and an index of the shard (suffix array or FM-index, given as `classes`) finds which
   windows are equal. A task works through its shards of SHARD symbols one after the other.
4. An anchor with more than HOT contents is dealt over salts; its shards then pass on one row a class
   of equal windows and the windows that are still undecided, which are decided by hash: exact as well.
5. Decisions go back to all runs of a content, are gathered for each document, and applied to its text.

Windows are judged on the input. mode "all": a window goes if it also starts anywhere else;
mode "later": only if it also starts earlier (smaller doc_id, or same document and earlier start).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warpline.llm.anchors import records
from warpline.llm.common import NO_ID, buffers, materialise, partitions, release, remove, small_batches, table

SHARD, HOT = 1 << 20, 12_000  # 12,000 slices of about 300 bytes are what one task holds at ease
Classes = Callable[[list, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """nid (a null doc_id counts as the smallest), th (tells texts of one doc_id apart), doc_id, text."""
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return d.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("nid"), F.xxhash64("text").alias("th"), "doc_id", "text")


RUNS = pa.schema([("nid", pa.int64()), ("th", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("akey", pa.int64()), ("chash", pa.int64())])
RUNS_DDL = "nid long, th long, first int, last int, akey long, chash long"


def runs(docs: DataFrame, words: bool, window: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            raw, off = buffers(b.column(2))
            data = raw.tobytes()
            if words:
                split = [data[s:e].split() for s, e in zip(off[:-1].tolist(), off[1:].tolist())]
                off = np.cumsum([0, *map(len, split)])
                flat = [w for s in split for w in s]
                symbols = np.fromiter(map(digest, flat), np.uint64, len(flat))
                joined = b" ".join(flat)
                ends = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)) + 1) - 1
                starts = np.concatenate([[0], ends[:-1] + 1]) if len(flat) else ends
            else:
                symbols, joined = raw, data
            doc, first, last, anchor = records(symbols, off, window, k)
            s, e = off[doc] + first, off[doc] + last + window
            if words:
                s, e = starts[s] if len(s) else s, ends[e - 1] if len(e) else e
            content = np.fromiter((digest(joined[x:y]) for x, y in zip(s.tolist(), e.tolist())), np.uint64, len(s))
            yield table({"nid": np.asarray(b.column(0))[doc], "th": np.asarray(b.column(1))[doc], "first": first.astype(np.int32), "last": last.astype(np.int32), "akey": anchor.view(np.int64), "chash": content.view(np.int64)}, RUNS)

    small_batches(docs.sparkSession)
    return docs.select("nid", "th", "text").mapInArrow(run, RUNS_DDL)


def packed(docs: DataFrame) -> DataFrame:
    """nid, th, doc_id and the text as a compressed binary, which halves what joins shuffle."""
    schema = pa.schema([("nid", pa.int64()), ("th", pa.int64()), ("doc_id", pa.int64()), ("z", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield table({"nid": b.column(0), "th": b.column(1), "doc_id": b.column(2), "z": [press.compress(t.encode()) for t in b.column(3).to_pylist()]}, schema)

    return docs.mapInArrow(run, "nid long, th long, doc_id long, z binary")


SLICES = pa.schema([("akey", pa.int64()), ("salt", pa.int32()), ("chash", pa.int64()), ("copies", pa.int64()), ("nid", pa.int64()), ("first", pa.int32()), ("content", pa.binary())])


def slices(texts: DataFrame, wanted: DataFrame, words: bool, window: int) -> DataFrame:
    """The texts of wanted runs: wanted has nid, th, parts (first, last, akey, chash, copies, salt)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            cols: dict[str, list] = {n: [] for n in SLICES.names}
            size = 0
            for nid, z, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                text = open_.decompress(z)
                units = text.split() if words else text
                for p in parts:
                    part = units[p["first"] : p["last"] + window]
                    for n in ("akey", "salt", "chash", "copies", "first"):
                        cols[n].append(p[n])
                    cols["nid"].append(nid)
                    cols["content"].append(b" ".join(part) if words else part)
                    size += len(cols["content"][-1])
                if size > 8 << 20:
                    yield table(cols, SLICES)
                    cols, size = {n: [] for n in SLICES.names}, 0
            yield table(cols, SLICES)

    got = texts.join(wanted, ["nid", "th"]).select("nid", "z", "parts")
    return got.mapInArrow(run, "akey long, salt int, chash long, copies long, nid long, first int, content binary")


FOUND = pa.schema([("akey", pa.int64()), ("chash", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("whash", pa.binary()), ("nid", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("ask", pa.bool_())])
FOUND_DDL = "akey long, chash long, low int, high int, whash binary, nid long, at long, size long, ask boolean"


def _decide(held: list[tuple], salted: bool, words: bool, window: int, mode: str, classes: Classes) -> pa.RecordBatch | None:
    """Of one shard: stretches of windows that go; from salted shards also classes and open windows."""
    akey, chash, copies, nid, first = (np.array(x) for x in list(zip(*held, strict=True))[:5])
    contents = [h[5].split() if words else h[5] for h in held]
    who, offset, same = classes(contents, window)
    if not len(who):
        return None
    order = np.lexsort((offset, first[who] + offset, nid[who], same))
    who, offset, same = who[order], offset[order], same[order]
    fresh = np.concatenate([[True], same[1:] != same[:-1]])
    start = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    size = np.diff(np.append(start, len(same)))
    owner, place = nid[who], first[who] + offset
    head = start[group]
    later = (owner != owner[head]) | (place != place[head])
    gone = size[group] > 1 if mode == "all" else later
    out = {n: [] for n in FOUND.names}
    at = np.flatnonzero(gone & (copies[who] == 1) if mode == "all" else gone)
    at = at[np.lexsort((offset[at], who[at]))]
    if len(at):
        w, o = who[at], offset[at]
        cut = np.concatenate([[True], (w[1:] != w[:-1]) | (o[1:] != o[:-1] + 1)])
        s = np.flatnonzero(cut)
        e = np.append(s[1:], len(at)) - 1
        n = len(s)
        out = {"akey": akey[w[s]].tolist(), "chash": chash[w[s]].tolist(), "low": o[s].tolist(), "high": o[e].tolist(), "whash": [None] * n, "nid": [None] * n, "at": [None] * n, "size": [None] * n, "ask": [False] * n}
    if salted:
        weight = np.add.reduceat(copies[who], start)
        asks = ~gone if mode == "all" else head == np.arange(len(who))
        for i in np.flatnonzero(asks | fresh).tolist():
            part = contents[who[i]][offset[i] : offset[i] + window]
            row = (int(akey[who[i]]), int(chash[who[i]]), int(offset[i]), int(offset[i]), xxhash.xxh3_128_digest(b" ".join(part) if words else part), int(owner[i]), int(place[i]), int(weight[group[i]]) if fresh[i] else 0, bool(asks[i]))
            for n, v in zip(FOUND.names, row, strict=True):
                out[n].append(v)
    return table(out, FOUND)


def search(cut: DataFrame, words: bool, window: int, mode: str, classes: Classes, shard: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group: list[tuple] = []
        size = 0
        key = None

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            got = _decide(held, False, words, window, mode, classes) if held else None
            held, size = [], 0
            if got is not None:
                yield got

        def close() -> Iterator[pa.RecordBatch]:
            """The rows of one anchor are complete; a salted one is a shard of its own."""
            nonlocal group, size
            if key and key[1] >= 0:
                got = _decide(group, True, words, window, mode, classes)
                if got is not None:
                    yield got
            else:
                held.extend(group)
                size += sum(len(g[5]) + 1 for g in group)
                if size > shard:
                    yield from done()
            group = []

        for b in batches:
            for akey, salt, chash, copies, nid, first, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (akey, salt) != key:
                    if group:
                        yield from close()
                    key = (akey, salt)
                group.append((akey, chash, copies, nid, first, content))
        if group:
            yield from close()
        yield from done()

    spark = cut.sparkSession
    return cut.repartition(partitions(spark), "akey", "salt").sortWithinPartitions("akey", "salt").mapInArrow(run, FOUND_DDL)


def repeated(docs: DataFrame, texts: DataFrame, classes: Classes, *, words: bool, window: int, k: int, mode: str, shard: int | None = None, hot: int | None = None) -> DataFrame:
    """(nid, th, spans): for each document with repeats, stretches (s, e) of first places of windows that go."""
    shard, hot = shard or SHARD, hot or HOT
    every = materialise(runs(docs, words, window, k))
    known = materialise(every.groupBy("akey").agg(F.count("*").alias("n")).filter("n > 1").select("akey"))
    hits = materialise(every.join(known, "akey"))
    remove(every, known)
    release(docs.sparkSession)
    contents = materialise(hits.groupBy("akey", "chash").agg(F.count("*").alias("copies"), F.min(F.struct("nid", "first", "last", "th")).alias("rep")))
    several = materialise(contents.groupBy("akey").agg(F.count("*").alias("n")).filter("n > 1"))
    salt = F.when(F.col("n") > hot, F.pmod("chash", F.ceil(F.col("n") / F.lit(hot))).cast("int")).otherwise(F.lit(-1))
    open_ = contents.join(several, "akey").select("rep.nid", "rep.th", F.struct("rep.first", "rep.last", "akey", "chash", "copies", salt.alias("salt")).alias("part"))
    wanted = open_.groupBy("nid", "th").agg(F.collect_list("part").alias("parts"))
    one_text = texts.select("nid", "th", "z")
    found = materialise(search(slices(one_text, wanted, words, window), words, window, mode, classes, shard))
    release(docs.sparkSession)
    plain = found.filter("whash is null").select("akey", "chash", "low", "high")
    asked = found.filter("ask")
    if several.filter(F.col("n") > hot).limit(1).count():
        totals = materialise(found.filter("whash is not null").groupBy("whash").agg(F.sum("size").alias("total"), F.min(F.struct("nid", "at")).alias("low_at")))
        asks = materialise(asked).join(totals, "whash")
        go = asks.filter("total > 1") if mode == "all" else asks.filter(F.struct("nid", "at") > F.col("low_at"))
        plain = plain.unionByName(go.select("akey", "chash", "low", "high"))
    inner = plain.groupBy("akey", "chash").agg(F.collect_set(F.struct("low", "high")).alias("inner"))
    facts = contents.join(inner, ["akey", "chash"], "left").filter("copies > 1 or inner is not null")
    facts = materialise(facts.select("akey", "chash", "copies", F.col("rep.nid").alias("rep_nid"), F.col("rep.first").alias("rep_first"), "inner"))
    whole = F.col("copies") > 1 if mode == "all" else F.struct("nid", "first") > F.struct(F.col("rep_nid").alias("nid"), F.col("rep_first").alias("first"))
    span = F.when(whole, F.array(F.struct(F.col("first").alias("s"), F.col("last").alias("e")))).otherwise(F.transform("inner", lambda x: F.struct((x["low"] + F.col("first")).alias("s"), (x["high"] + F.col("first")).alias("e"))))
    spans = hits.join(facts, ["akey", "chash"]).select("nid", "th", span.alias("span")).filter("span is not null")
    # a set: rows that repeat one text under one id bring the same stretches, and are combined before the shuffle
    out = materialise(spans.groupBy("nid", "th").agg(F.flatten(F.collect_set("span")).alias("spans")))
    remove(hits, contents, several, found, facts)
    release(docs.sparkSession)
    return out


def covered(spans: list | None, window: int) -> list[tuple[int, int]]:
    """Maximal removed stretches [start, end) from stretches of window starts."""
    out: list[list[int]] = []
    for s, e in sorted((p["s"], p["e"] + window) for p in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


KEPT = pa.schema([("doc_id", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def cut(texts: DataFrame, spans: DataFrame, *, words: bool, window: int, keep_text: bool, characters: bool = False) -> DataFrame:
    """Each document without its removed units: counts, digest and, if asked for, the kept bytes.

    characters: of each kept stretch only whole characters, and nid and th are passed on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for doc, z, found, *_ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = open_.decompress(z)
                units = text.split() if words else text
                gone, parts, at = covered(found, window), [], 0
                for s, e in gone:
                    parts.append(units[at:s])
                    at = e
                parts.append(units[at:])
                if characters:
                    parts = [p.decode(errors="ignore").encode() for p in parts]
                kept = b" ".join(w for p in parts for w in p) if words else b"".join(parts)
                rows.append((doc, len(units), sum(e - s for s, e in gone), len(gone), hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            cols = dict(zip(KEPT.names, zip(*rows), strict=True)) if rows else {n: [] for n in KEPT.names}
            yield table(cols | ({"nid": b.column(3), "th": b.column(4)} if characters else {}), schema)

    own = ["nid", "th"] if characters else []
    schema = pa.schema([*KEPT, *((n, pa.int64()) for n in own)])
    return texts.join(spans, ["nid", "th"], "left").select("doc_id", "z", "spans", *own).mapInArrow(run, "doc_id long, n_units long, n_removed long, n_spans long, kept_sha256 string, kept binary" + "".join(f", {n} long" for n in own))
