"""Token ids in a binary format: static range asymmetric numeral system, in independent blocks.

Format, one row a block (Parquet keeps the bytes, so any file system Spark knows can hold it):
- one frequency table for all blocks (`freq`: 2**SCALE slots over the vocabulary, every id at least 1);
- a block codes up to BLOCK ids, interleaved over LANES coder states: id i goes to lane i mod LANES;
- `words` are the 32-bit words in the order the decoder takes them, `states` the decoder's first states;
- every CHECK steps a checkpoint holds the states and the place in `words`: the parts of a block between
  checkpoints are decoded side by side, or one of them alone; `crc32` is over the block's ids as little-endian unsigned 32-bit integers;
- `docs`, `pieces` and `sizes` say which documents, and which piece of each, the ids belong to.

Blocks follow ascending doc_id; a shard is one range of doc_ids, and block `first` is relative to its
shard. Texts are encoded once, counted, dealt by range of doc_id, coded, written and read back.

Defined cases: a null or empty text is the end id alone; the strings of a tokenizer's added tokens (such as
<|endoftext|>) in a text become their ids, as in the library, unless special_as_text is set; repeated
doc_ids follow one another and keep a row each per copy of their text order (rows that agree in id and text
are interchangeable); null doc_ids come first; an empty table gives no blocks and an empty result; a long
text spans blocks; a vocabulary of more than 65,536 ids is refused.
"""

from __future__ import annotations

import functools
import gc
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from warpline.llm.common import buffers, id_text, materialise, partitions, release, remove, small_batches, table

SCALE, LANES, BLOCK, CHECK = 20, 4096, 1 << 20, 64
LOW = 1 << 31
CACHED = 1_500_000
#: the characters that byte-level tokenizers write for bytes: printable Latin-1 stands for itself
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
PLAIN = "\u0130"  # letters below it keep their form under NFC and lower one by one


def lowered(text: str) -> str:
    """Latin-1 texts in lower case, which the normaliser makes of them anyway; it leaves fewer forms of words."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text.lower()


#: fixed values: the normaliser and splitter for which the ids of a text are those of its words in a row
NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTER = [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]


class Words:
    """Ids of white-space separated words by the tokenizers library, with a bounded cache.

    A normaliser and splitter as above never join characters across a space or line feed, so the ids of a
    text are those of its words in a row. With any other tokenizer file the library gets whole texts.
    Added tokens are split off the raw text first, as the library does; as a word they are
    written with a blank before, which no word of a text has.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tok, self.whole = Tokenizer.from_file(path), Tokenizer.from_file(path)
        if self.tok.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        self.tok.encode_special_tokens, self.whole.encode_special_tokens = True, special_as_text
        made = json.loads(self.tok.to_str())
        added = self.tok.get_added_tokens_decoder()
        self.by_words = (made["normalizer"] or {}).get("normalizers") == NORMALISER and (made["pre_tokenizer"] or {}).get("pretokenizers") == SPLITTER
        self.by_words &= made["post_processor"] is None and not any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values())
        self.special = {} if special_as_text else {t.content: i for i, t in added.items()}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.ends = {c: np.array(self.tok.encode(c, add_special_tokens=False).ids, np.uint16).tobytes() for c in ("", ",", ".")}
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {"": 0} | {" " + s: i for i, s in enumerate(self.special, 1)}
        self.stems: dict[str, bytes] = {}
        self.flat: list[np.ndarray] = [np.array(list(self.special.values()), np.uint16)]
        self.sizes: list[np.ndarray] = [np.array([0] + [1] * len(self.special), np.int64)]

    def split(self, text: str) -> list[str]:
        if not any(s in text for s in self.special):
            return lowered(text).replace("\n", " ").split(" ")
        out: list[str] = []
        for part in self.parts.split(text):
            out += [" " + part] if part in self.special else lowered(part).replace("\n", " ").split(" ")
        return out

    def learn(self, words: list[str]) -> None:
        """Letters before a closing comma or full stop are a word of their own, in either case."""
        gc.disable()  # nothing below makes cycles, but its many small tuples would set off collections
        stems, tails = [], []
        known, letters, others = self.stems, [], []
        for w in words:
            end = w[-1]
            stem = w[:-1] if end in ",." else w
            if stem.isalpha() and (stem.isascii() or max(stem) < PLAIN):
                tails.append(end if stem is not w else "")
                stem = stem.lower()
                if stem not in known:
                    known[stem] = b""
                    letters.append(stem)
            else:
                stem = w
                tails.append("")
                if stem not in known:
                    known[stem] = b""
                    others.append(stem)
            stems.append(stem)
        tokenize = self.tok.model.tokenize
        for w in letters:  # one match of the splitter each, so the merges alone give the ids
            parts = tokenize(w if w.isascii() else "".join([BYTE_CHARS[c] for c in w.encode()]))
            known[w] = array("H", [p.id for p in parts]).tobytes()
        if others:
            e = self.tok.encode(" ".join(others), add_special_tokens=False)
            ends = np.cumsum([len(w) + 1 for w in others])
            starts = np.array(e.offsets, np.int64).reshape(-1, 2)[:, 0]
            edges = np.searchsorted(starts, np.concatenate([[0], ends])).tolist()
            raw = np.array(e.ids, np.uint16).tobytes()
            known.update(zip(others, [raw[2 * a : 2 * b] for a, b in zip(edges, edges[1:])], strict=True))
        tail = self.ends
        parts = [known[s] + tail[t] if t else known[s] for s, t in zip(stems, tails)]
        base = len(self.index)
        self.index.update(zip(words, range(base, base + len(words))))
        self.flat.append(np.frombuffer(b"".join(parts), np.uint16))
        self.sizes.append(np.fromiter(map(len, parts), np.int64, len(parts)) // 2)
        gc.enable()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text)."""
        if not self.by_words:
            ids = [e.ids for e in self.whole.encode_batch(texts, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(ids), np.uint16), np.array([len(x) for x in ids], np.int64)
        if len(self.index) > CACHED:
            self.clear()
        split = [self.split(t) for t in texts]
        counts = [len(w) for w in split]
        flat_words = list(chain.from_iterable(split))
        words = np.fromiter(map(self.index.get, flat_words, repeat(-1)), np.int64, len(flat_words))
        missing = np.flatnonzero(words < 0).tolist()
        if missing:
            self.learn(list(dict.fromkeys(flat_words[i] for i in missing)))
            self.flat, self.sizes = [np.concatenate(self.flat)], [np.concatenate(self.sizes)]
            words[missing] = [self.index[flat_words[i]] for i in missing]
        flat, sizes = self.flat[0], self.sizes[0]
        starts = np.cumsum(sizes) - sizes
        n = sizes[words]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(starts[words] - (ends - n), n) + np.arange(total)]
        edge = np.concatenate([[0], ends])[np.cumsum([0, *counts])]
        return ids, np.diff(edge)


@functools.lru_cache(maxsize=2)
def words(path: str, special_as_text: bool = False) -> Words:
    return Words(path, special_as_text)


TOKENS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """doc_id, ids (unsigned 16-bit, little endian) with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words(tokenizer_path, special_as_text)
        end = np.uint16(end_id).tobytes()
        for b in batches:
            ids, sizes = w.encode(b.column(1).to_pylist())
            edges = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            yield table({"doc_id": b.column(0), "ids": [ids[s:e].tobytes() + end for s, e in zip(edges, edges[1:])]}, TOKENS)

    small_batches(docs.sparkSession)
    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def count_ids(tokens: DataFrame) -> DataFrame:
    """(id, count) over all rows; at most one row an id and task before the shuffle."""
    schema = pa.schema([("id", pa.int32()), ("count", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            total += np.bincount(buffers(b.column(0))[0].view(np.uint16), minlength=1 << 16)
        at = np.flatnonzero(total)
        yield table({"id": at.astype(np.int32), "count": total[at]}, schema)

    return tokens.select("ids").mapInArrow(run, "id int, count long").groupBy("id").agg(F.sum("count").alias("count"))


def frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Counts scaled to 2**scale slots, every id at least 1; the largest take what rounding leaves."""
    room = (1 << scale) - len(counts)
    total = max(1, int(counts.sum()))
    freq = 1 + (counts.astype(object) * room // total).astype(np.int64) if total > 2**40 else 1 + counts * room // total
    freq[int(np.argmax(freq))] += (1 << scale) - int(freq.sum())
    return freq


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint16), freq)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
        """(words, first states of the decoder, checkpoints)."""
        n = len(ids)
        steps = -(-n // LANES)
        x = np.full(LANES, LOW, np.uint64)
        out: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        taken = 0
        for k in range(steps - 1, -1, -1):
            ids_k = ids[k * LANES : (k + 1) * LANES]
            m = len(ids_k)
            f, c, y = self.freq[ids_k], self.start[ids_k], x[:m]
            over = y >= f << np.uint64(63 - SCALE)
            if over.any():
                out.append((y[over] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
                taken += len(out[-1])
                y = np.where(over, y >> np.uint64(32), y)
            q = y // f
            x[:m] = (q << np.uint64(SCALE)) + (y - q * f) + c
            if k and k % CHECK == 0:
                marks.append((taken, x.copy()))
        body = np.concatenate(out[::-1]) if out else np.empty(0, np.uint32)
        checks = b"".join(np.uint64(len(body) - t).tobytes() + s.tobytes() for t, s in marks[::-1])
        return body.tobytes(), x.tobytes(), checks

    def decode(self, body: bytes, states: bytes, n: int, steps: range | None = None, at: int = 0) -> np.ndarray:
        w = np.frombuffer(body, np.uint32)
        x = np.frombuffer(states, np.uint64).copy()
        steps = range(-(-n // LANES)) if steps is None else steps
        out = np.empty(n, np.uint16)
        mask = np.uint64((1 << SCALE) - 1)
        for k in steps:
            m = min(LANES, n - k * LANES)
            y = x[:m]
            slot = y & mask
            s = self.symbol[slot]
            out[k * LANES : k * LANES + m] = s
            y = self.freq[s] * (y >> np.uint64(SCALE)) + slot - self.start[s]
            low = y < LOW
            need = int(low.sum())
            if need:
                y[low] = (y[low] << np.uint64(32)) | w[at : at + need]
                at += need
            x[:m] = y
        return out[steps.start * LANES : min(n, steps.stop * LANES)]

    def decode_block(self, body: bytes, states: bytes, checks: bytes, n: int) -> np.ndarray:
        """All ids of a block: its parts, each from its own checkpoint, a step of all parts at a time."""
        steps = -(-n // LANES)
        marks = np.frombuffer(checks, np.uint64).reshape(-1, 1 + LANES)
        x = np.concatenate([np.frombuffer(states, np.uint64)[None], marks[:, 1:]])
        at = [0, *marks[:, 0].tolist()]
        w, mask = np.frombuffer(body, np.uint32), np.uint64((1 << SCALE) - 1)
        out = np.empty((len(x), CHECK, LANES), np.uint16)
        for k in range(min(CHECK, steps)):
            p = -(-(steps - k) // CHECK)  # parts that are as long
            y = x[:p]
            slot = y & mask
            s = self.symbol[slot]
            out[:p, k] = s
            y = self.freq[s] * (y >> np.uint64(SCALE)) + slot - self.start[s]
            for j in range(p):
                m = min(LANES, n - (j * CHECK + k) * LANES)
                low = np.flatnonzero(y[j, :m] < LOW)
                y[j, low] = (y[j, low] << np.uint64(32)) | w[at[j] : at[j] + len(low)]
                at[j] += len(low)
            x[:p] = y
        return out.reshape(-1)[:n]

    def decode_part(self, body: bytes, checks: bytes, n: int, part: int) -> np.ndarray:
        """Ids from checkpoint `part` (1, 2, ...) to the next one, without what comes before."""
        size = 8 + LANES * 8
        mark = checks[(part - 1) * size : part * size]
        stop = min((part + 1) * CHECK, -(-n // LANES))
        return self.decode(body, mark[8:], n, range(part * CHECK, stop), int(np.frombuffer(mark[:8], np.uint64)[0]))


BLOCKS = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("words", pa.binary()), ("states", pa.binary()), ("checkpoints", pa.binary()), ("crc32", pa.int64()), ("docs", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("copies", pa.list_(pa.int32()))])
BLOCKS_DDL = "shard int, block int, first long, n long, words binary, states binary, checkpoints binary, crc32 long, docs array<long>, pieces array<int>, sizes array<int>, copies array<int>"


def pack(tokens: DataFrame, freq: np.ndarray, n_shards: int) -> DataFrame:
    """Blocks of tokens (doc_id, ids) in ascending doc_id order."""
    sent = tokens.sparkSession.sparkContext.broadcast(freq)  # one entry for each id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, shard = Coder(sent.value), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        meta: list[tuple] = []
        n = block = first = copy = 0
        last: tuple = ()

        def flush() -> pa.RecordBatch:
            nonlocal held, meta, n, block, first
            ids = np.concatenate(held)
            body, states, checks = coder.encode(ids)
            row = {"shard": [shard], "block": [block], "first": [first], "n": [n], "words": [body], "states": [states], "checkpoints": [checks], "crc32": [zlib.crc32(ids.astype("<u4").tobytes())]}
            row |= {k: [list(v)] for k, v in zip(("docs", "pieces", "sizes", "copies"), zip(*meta), strict=True)}
            block, first, held, meta, n = block + 1, first + n, [], [], 0
            return table(row, BLOCKS)

        for b in batches:
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(raw, np.uint16)
                copy = copy + 1 if last == (doc,) else 0
                last, piece = (doc,), 0
                while len(ids):
                    take = ids[: BLOCK - n]
                    held.append(take)
                    meta.append((doc, piece, len(take), copy))
                    n, ids, piece = n + len(take), ids[len(take) :], piece + 1
                    if n == BLOCK:
                        yield flush()
        if n:
            yield flush()

    return tokens.repartitionByRange(n_shards, F.col("doc_id"), F.xxhash64("ids")).sortWithinPartitions("doc_id", "ids").mapInArrow(run, BLOCKS_DDL)


PIECES = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("copy", pa.int32()), ("piece", pa.int32()), ("at", pa.int64()), ("size", pa.int64()), ("crc", pa.int64())])


def unpack(blocks: DataFrame, freq: np.ndarray) -> DataFrame:
    """Decoded pieces of documents: place in the shard, number of ids and their crc32; a bad block raises."""
    sent = blocks.sparkSession.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(sent.value)
        for b in batches:
            for r in b.to_pylist():
                ids = coder.decode_block(r["words"], r["states"], r["checkpoints"], r["n"]).astype("<u4")
                if zlib.crc32(ids.tobytes()) != r["crc32"]:
                    raise ValueError(f"block {r['block']} of shard {r['shard']} is damaged")
                sizes = np.array(r["sizes"], np.int64)
                edges = np.concatenate([[0], np.cumsum(sizes)])
                crcs = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(edges.tolist(), edges[1:].tolist())]
                yield table({"shard": [r["shard"]] * len(sizes), "doc_id": r["docs"], "copy": r["copies"], "piece": r["pieces"], "at": r["first"] + edges[:-1], "size": sizes, "crc": crcs}, PIECES)

    return blocks.mapInArrow(run, "shard int, doc_id long, copy int, piece int, at long, size long, crc long")


def crc32_join(crcs: list[int], sizes: list[int]) -> int:
    """crc32 of joined byte strings from their crc32s and lengths (linear algebra over bits)."""
    out = crcs[0]
    for crc, size in zip(crcs[1:], sizes[1:], strict=True):
        # shifting by `size` zero bytes is linear: square the one-byte operator along the bits of size
        op = [zlib.crc32(b"\0", 0xFFFFFFFF ^ (1 << i)) ^ zlib.crc32(b"\0", 0xFFFFFFFF) for i in range(32)]

        def apply(m: list[int], v: int) -> int:
            r = 0
            for i in range(32):
                if v >> i & 1:
                    r ^= m[i]
            return r

        while size:
            if size & 1:
                out = apply(op, out)
            op = [apply(op, v) for v in op]
            size >>= 1
        out ^= crc
    return out


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int, vocabulary: int, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> tuple[DataFrame, np.ndarray]:
    """(blocks as read back from the shared folder, frequency table)."""
    spark: SparkSession = docs.sparkSession
    tokens = materialise(tokenise(docs, tokenizer_path, end_id, id_col, text_col, special_as_text))
    counts = np.zeros(vocabulary, np.int64)
    for r in count_ids(tokens).collect():  # one row an id of the vocabulary at most
        counts[r["id"]] = r["count"]
    freq = frequencies(counts)
    blocks = materialise(pack(tokens, freq, partitions(spark)))
    remove(tokens)
    release(spark)
    return blocks, freq


def read_digest(blocks: DataFrame, freq: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the written blocks."""
    shards = blocks.groupBy("shard").agg(F.sum("n").alias("ids"))  # one row a shard
    base = shards.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("base"))
    pieces = unpack(blocks, freq)
    whole = F.array_sort(F.collect_list(F.struct("piece", "size", "crc")))
    docs = pieces.groupBy("shard", "doc_id", "copy").agg(F.min("at").alias("at"), F.sum("size").alias("n_tokens"), whole.alias("parts"))

    @F.pandas_udf("long")
    def joined(parts):  # only documents that span blocks
        return parts.map(lambda p: crc32_join([x["crc"] for x in p], [x["size"] * 4 for x in p]))

    one = docs.filter(F.size("parts") == 1).withColumn("ids_crc32", F.col("parts")[0]["crc"])
    more = docs.filter(F.size("parts") > 1).withColumn("ids_crc32", joined("parts"))
    return one.unionByName(more).join(F.broadcast(base), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
