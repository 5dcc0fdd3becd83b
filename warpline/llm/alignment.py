"""Alignment of two tokenizers by a dangling-suffix transducer.

Tokens of one text in two vocabularies are laid side by side as bytes. At any place one side leads and has some unmatched bytes,
the dangling suffix; the lagging side reads its next token. A token shorter than the suffix shortens it, one of equal length
empties it, which closes a group, and a longer one makes its own rest the new suffix, with the other side
leading. States (leading side, suffix) and their transitions by next token are memoised. A suffix is always the end of a
token, so both are bounded by the vocabularies, not by the corpus.

A link is a pair of tokens that end together: the last ones of each group. One of the two is then a suffix of the other, so
distinct pairs number at most the sum of all token lengths. Their corpus-wide counts therefore come to the driver and
are broadcast, with that proven bound.

Side A is a byte-level BPE file of the tokenizers library and reads a space and the text; side B is a sentencepiece model, which adds that
space itself. An untouched byte-level file (no normaliser, the usual splitter, merges in order of ids) is encoded with its own ranks and merges by the tiktoken
library, which gives the same ids at a quarter of the time; any other file is encoded by the tokenizers library.

Defined cases: null and empty texts, and texts whose joined bytes of either side differ from a space and the text (a normaliser
changed them, or they hold what stands for a space), have no tokens and no groups. Repeated rows are aligned and counted one by one; ties of count
are all best. Null doc_ids stay. An empty table gives an empty table. Extra columns are not read. Long texts are aligned whole: they are cut for the encoders only
before a space between two ASCII letters, where neither vocabulary has a token across.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from warpline.llm.common import id_text, small_batches, table

PART = 1 << 20  # characters that an encoder gets at once
EDGE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
ROWS = 100  # alignments that are taken apart at once


@functools.cache
def alphabet() -> dict[str, int]:
    """Byte of each character of byte-level vocabularies: printable Latin-1 stands for itself, the rest for code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class SideA:
    """A byte-level BPE file: ids of texts and bytes of ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = json.load(f)
        byte, self.library, self.ranks = alphabet(), None, None
        special = {t["content"] for t in raw.get("added_tokens", [])}
        vocab = {k: i for k, i in raw["model"]["vocab"].items() if k not in special}
        self.tokens = [b""] * (1 + max([*raw["model"]["vocab"].values(), *(t["id"] for t in raw.get("added_tokens", []))]))
        for t in raw.get("added_tokens", []):
            self.tokens[t["id"]] = t["content"].encode()
        for k, i in vocab.items():
            self.tokens[i] = bytes(byte[c] for c in k)
        merges = [m if isinstance(m, list) else m.split(" ") for m in raw["model"]["merges"]]
        made = [vocab.get(a + b, -1) for a, b in merges]
        first = raw.get("pre_tokenizer") or {}
        plain = raw.get("normalizer") is None and (first.get("type"), first.get("add_prefix_space"), first.get("use_regex", True)) == ("ByteLevel", False, True)
        options = not any(raw["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if plain and options and made == sorted(made) and len(vocab) == 256 + len(merges) and made[:1] == [256]:
            ranks = {self.tokens[i]: i for i in vocab.values()}
            self.ranks = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        else:
            self.library = Tokenizer.from_file(path)
            self.library.encode_special_tokens = True

    def encode(self, text: str) -> list[int]:
        return self.ranks.encode_ordinary(text) if self.ranks else self.library.encode(text, add_special_tokens=False).ids


class SideB:
    """A sentencepiece model: ids of texts and bytes of ids."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.tokens = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuttable = not any("▁" in p.lstrip("▁") for p in pieces)

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


class Transducer:
    """States are dictionaries from next token to state; the key -1 says which side reads: 0 for B, 1 for A."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.read = (b, a)
        self.closed: dict = {-1: 0}
        self.states: dict[tuple[int, bytes], dict] = {}
        self.suffix: dict[int, bytes] = {}
        self.lead = [self.state(0, t) if t else None for t in a]

    def state(self, reader: int, suffix: bytes) -> dict:
        s = self.states.get((reader, suffix))
        if s is None:
            s = self.states[reader, suffix] = {-1: reader}
            self.suffix[id(s)] = suffix
        return s

    def learn(self, state: dict, token: int) -> dict:
        reader, suffix = state[-1], self.suffix[id(state)]
        t = self.read[reader][token]
        if t == suffix:
            to = self.closed
        elif suffix.startswith(t):
            to = self.state(reader, suffix[len(t) :])
        elif t.startswith(suffix):
            to = self.state(1 - reader, t[len(suffix) :])
        else:
            raise ValueError("the two sides spell different bytes")
        state[token] = to
        return to

    def run(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
        """(tokens of A, tokens of B) read when each group closes."""
        lead, closed, learn = self.lead, self.closed, self.learn
        i = j = 0
        ends_a, ends_b, n = [], [], len(a)
        add_a, add_b = ends_a.append, ends_b.append
        while i < n:
            state = lead[a[i]]  # B reads next
            i += 1
            while True:
                t = b[j]
                j += 1
                state = state.get(t) or learn(state, t)
                if state is closed:
                    break
                while state[-1]:  # A reads until it leads or a group closes
                    t = a[i]
                    i += 1
                    state = state.get(t) or learn(state, t)
                if state is closed:
                    break
            add_a(i)
            add_b(j)
        return ends_a, ends_b


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = SideA(path_a), SideB(path_b)
        self.transducer = Transducer(self.a.tokens, self.b.tokens)

    def parts(self, text: str) -> list[str]:
        if len(text) <= PART or not self.b.cuttable:
            return [text]
        out, s = [], 0
        while len(text) - s > PART and (m := EDGE.search(text, s + PART)):
            out.append(text[s : m.start()])
            s = m.end()  # both sides put this space before the next part
        return [*out, text[s:]]

    def align(self, text: str | None) -> tuple[list[int], list[int], list[int], list[int]]:
        """(ids of A, ids of B, ends of groups in A, ends of groups in B)."""
        if not text:
            return [], [], [], []
        parts = self.parts(text)
        a, b = self.a.encode(" " + parts[0]), self.b.encode(parts[0])
        for p in parts[1:]:
            a += self.a.encode(" " + p)
            b += self.b.encode(p)
        whole = (" " + text).encode()
        # own ranks spell any bytes, as every single byte is a token
        if b"".join(map(self.b.tokens.__getitem__, b)) != whole or not self.a.ranks and b"".join(map(self.a.tokens.__getitem__, a)) != whole:
            return [], [], [], []
        return a, b, *self.transducer.run(a, b)


@functools.lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


PACKED = pa.schema([("doc_id", pa.int64()), ("a_ids", pa.binary()), ("a_last", pa.binary()), ("b_ids", pa.binary()), ("b_last", pa.binary())])


def _bits(ends: list[int], n: int) -> bytes:
    last = np.zeros(n + 1, np.uint8)
    last[np.frombuffer(array("q", ends), np.int64)] = 1
    return np.packbits(last[1:]).tobytes()


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the alignment: ids of both sides as little-endian unsigned 32-bit integers, and a bit a token that is set where it is its group's last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = aligner(path_a, path_b)
        for batch in batches:
            out = {n: [] for n in PACKED.names}
            out["doc_id"] = batch.column(0)
            for text in batch.column(1).to_pylist():
                a, b, ea, eb = x.align(text)
                out["a_ids"].append(np.frombuffer(array("i", a), np.int32).astype("<u4").tobytes())
                out["b_ids"].append(np.frombuffer(array("i", b), np.int32).astype("<u4").tobytes())
                out["a_last"].append(_bits(ea, len(a)))
                out["b_last"].append(_bits(eb, len(b)))
            yield table(out, PACKED)

    small_batches(docs.sparkSession)
    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, a_ids binary, a_last binary, b_ids binary, b_last binary")


class Side(NamedTuple):
    """One side of a batch of alignments: all ids, whether each is its group's last, and tokens of each document."""

    ids: np.ndarray
    last: np.ndarray
    n: np.ndarray


def _side(ids: pa.Array, last: pa.Array) -> Side:
    rows = ids.to_pylist()
    n = np.fromiter((len(r) // 4 for r in rows), np.int64, len(rows))
    flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=k) for x, k in zip(last.to_pylist(), n.tolist())]
    return Side(np.frombuffer(b"".join(rows), "<u4").astype(np.int64), np.concatenate(flags).astype(bool) if flags else np.empty(0, bool), n)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(s, ROWS) for b in batches for s in range(0, b.num_rows, ROWS))


def _sides(b: pa.RecordBatch) -> tuple[Side, Side]:
    col = lambda name: b.column(b.schema.get_field_index(name))
    return _side(col("a_ids"), col("a_last")), _side(col("b_ids"), col("b_last"))


GROUPS = pa.schema([("doc_id", pa.int64()), ("group", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32()))])


def _lists(s: Side) -> pa.ListArray:
    """The ids of each group."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.flatnonzero(s.last) + 1), pa.int32()), pa.array(s.ids, pa.int32()))


def groups(aligned: DataFrame) -> DataFrame:
    """One row a group: doc_id, its number in the document from 0, and its ids on both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            a, b = _sides(batch)
            off = np.append(0, np.cumsum(a.n))
            doc = np.searchsorted(off, np.flatnonzero(a.last), "right") - 1
            number = np.arange(len(doc)) - np.searchsorted(doc, doc)
            yield table({"doc_id": batch.column(0).take(pa.array(doc)), "group": number, "a_ids": _lists(a), "b_ids": _lists(b)}, GROUPS)

    return aligned.mapInArrow(run, "doc_id long, group long, a_ids array<int>, b_ids array<int>")


PAIRS = pa.schema([("pair", pa.int64()), ("n", pa.int64())])
WIDTH = 1 << 32  # pair: id of A * WIDTH + id of B


def _pairs(a: Side, b: Side) -> np.ndarray:
    return a.ids[a.last] * WIDTH + b.ids[b.last]


def link_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n): how many links hold each pair of ids linked. Tasks count first, so few rows are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in _slices(batches):
            k, m = np.unique(_pairs(*_sides(batch)), return_counts=True)
            both, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, m]), len(both)).astype(np.int64)
            keys = both
        yield table({"pair": keys, "n": n}, PAIRS)

    counted = aligned.select("a_ids", "a_last", "b_ids", "b_last").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return counted.select(F.floor(F.col("pair") / WIDTH).alias("a"), (F.col("pair") % WIDTH).alias("b"), "n")


DIGEST = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])


@functools.lru_cache(maxsize=4)
def _spelled(size: int, more: str, end: str) -> tuple[list[str], list[str]]:
    """An id with what follows it inside its group and at the group's end."""
    return [f"{i}{more}" for i in range(size)], [f"{i}{end}" for i in range(size)]


def _digests(a: Side, b: Side) -> list[str]:
    size = 1 + int(max(a.ids.max(initial=0), b.ids.max(initial=0)))
    words = [*_spelled(size, ",", "|")[0], *_spelled(size, ",", "|")[1], *_spelled(size, ",", ";")[1]]
    # tokens of a group follow one another: first those of A, then those of B
    group_a, group_b = np.cumsum(a.last) - a.last, np.cumsum(b.last) - b.last
    of_group = np.bincount(group_a, minlength=int(group_b.max(initial=-1)) + 1)
    place_a = np.arange(len(group_a)) + (np.cumsum(b_n := np.bincount(group_b, minlength=len(of_group))) - b_n)[group_a]
    place_b = np.arange(len(group_b)) + np.cumsum(of_group)[group_b]
    code = np.empty(len(group_a) + len(group_b), np.int64)
    code[place_a] = a.ids + size * a.last
    code[place_b] = b.ids + 2 * size * b.last
    off = np.append(0, np.cumsum(a.n + b.n)).tolist()
    spelled = list(map(words.__getitem__, code.tolist()))
    return [hashlib.sha256("".join(spelled[i:j])[:-1].encode()).hexdigest() if j > i else "" for i, j in zip(off, off[1:])]


def digest(aligned: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of stored alignments."""
    spark = aligned.sparkSession
    t = link_counts(aligned).withColumn("best", F.max("n").over(Window.partitionBy("b"))).orderBy("a", "b").toArrow()
    keys = t.column("a").to_numpy() * WIDTH + t.column("b").to_numpy()
    n = t.column("n").to_numpy()
    known = spark.sparkContext.broadcast((keys, n, n == t.column("best").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, count, best = known.value
        for batch in _slices(batches):
            a, b = _sides(batch)
            at = np.searchsorted(keys, _pairs(a, b))
            off_a, rows = np.append(0, np.cumsum(a.n)), len(a.n)
            doc = np.searchsorted(off_a, np.flatnonzero(a.last), "right") - 1
            total = np.zeros(rows, np.int64)
            np.add.at(total, doc, count[at])
            links = np.bincount(doc, minlength=rows)
            yield table({"doc_id": batch.column(0), "n_a": a.n, "n_b": b.n, "n_groups": links, "n_links": links, "n_best": np.bincount(doc[best[at]], minlength=rows), "count_sum": total, "groups_sha256": _digests(a, b)}, DIGEST)

    return aligned.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")

