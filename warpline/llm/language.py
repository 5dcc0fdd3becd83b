"""Language ID with a blended-spectrum string kernel, Nystrom landmarks and kernel ridge regression.

A text is lower-cased, all but letters become single blanks, and its UTF-8 bytes are cut into segments
of SEGMENT bytes. A segment is the set of its 1-, 2- and 3-grams of bytes; the kernel of two segments is
the number of grams that both have over the root of the product of their sizes. LANDMARKS training
segments span the Nystrom approximation; one ridge regression for each language against the rest is
solved in it. Scoring multiplies a batch's presence matrix with the landmarks' weights folded over grams,
which is the same product in another order, and averages the segments of a text by length.

All labelled rows to learn from count: tasks sum the normal equations over their segments, in whole numbers, so the model doesn't
depend on how rows are dealt out. accept() learns from all segments of whole texts; identify() from at most SEGMENTS of each text,
spread evenly over all of it. Only the landmarks themselves, the basis, are drawn from few rows: those with the smallest hashes, PER_LANGUAGE
of each language and SAMPLE_ROWS in all. No language is left out unless there are more than SAMPLE_ROWS of them. Prediction reads
whole texts and only the text.

Defined cases: a null text, or one without a letter, is `und` with score 0; rows without a language are
never learned from; ties go to the language first in order; repeated rows are learned once and scored alike;
with no labelled row all texts are `und`; an empty table gives an empty result; extra columns are not read, and
accept() keeps columns of any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from warpline.llm.common import materialise, partitions, small_batches, table

SEGMENT, LANDMARKS, PER_LANGUAGE, SEGMENTS, SAMPLE_ROWS, SHORT = 1000, 400, 400, 4, 20_000, 40
RIDGE, SHARPNESS, BLOCK = 1e-3, 4.0, 512
ASCII_LETTER = re.compile("[A-Za-z]")
#: codes of bytes: 0 for blanks, a to z, then each byte over 127
CODE = np.zeros(256, np.int64)
CODE[97:123], CODE[128:] = np.arange(1, 27), np.arange(27, 155)
SIZE = 155


def has_letter(text: str | None) -> bool:
    return bool(text) and (ASCII_LETTER.search(text) is not None or not text.isascii() and any(map(str.isalpha, text)))


def normal(text: str) -> bytes:
    text = text.lower()
    if not text.isascii():
        text = "".join([c if c.isalpha() else " " for c in text]) if any(not (c.isalpha() or c.isascii()) for c in set(text)) else text
    return b" " + b" ".join(text.encode().translate(BLANK).split()) + b" "


BLANK = bytes(c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def grams(codes: np.ndarray) -> list[np.ndarray]:
    """Codes of the grams that start at each byte, for n = 1, 2, 3."""
    one = codes
    two = one[:-1] * SIZE + one[1:]
    three = two[:-1] * SIZE + one[2:]
    return [one, SIZE + two, SIZE + SIZE * SIZE + three]


SPACE = SIZE + SIZE**2 + SIZE**3


def spread(text: str, most: int | None = SEGMENTS) -> list[bytes]:
    """At most `most` (two or more) segments of a text, evenly over all of it; all for None."""
    clean = normal(text)
    count = max(1, -(-len(clean) // SEGMENT))
    at = range(count) if most is None or count <= most else [i * (count - 1) // (most - 1) for i in range(most)]
    return [clean[k * SEGMENT : (k + 1) * SEGMENT] for k in at]


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all codes, segment of each byte, text of each segment, bytes of each segment)."""
    length = np.array([len(t) for t in texts], np.int64)
    codes = CODE[np.frombuffer(b"".join(texts), np.uint8)]
    count = np.maximum(1, -(-length // SEGMENT))
    owner = np.repeat(np.arange(len(texts)), count)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(SEGMENT, length[owner] - rank * SEGMENT)
    return codes, np.repeat(np.arange(len(owner)), size), owner, size


def presence(codes: np.ndarray, segment: np.ndarray, column: np.ndarray, rows: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """(0/1 matrix of segments by known grams, number of all distinct grams of each segment).

    Grams that cross segments belong to none.
    """
    out = np.zeros((rows, columns + 1), bool)
    flat = out.reshape(-1)
    others = []
    for n, g in enumerate(grams(codes)):
        seg, at = segment[: len(g)], column[g]
        inside = seg == segment[n : n + len(g)] if n else np.ones(len(g), bool)
        flat[(seg * (columns + 1) + at)[inside]] = True
        new = inside & (at == columns)
        others.append(np.unique(seg[new].astype(np.int64) * SPACE + g[new]) // SPACE)
    known = out[:, :columns]
    return known, known.sum(axis=1) + np.bincount(np.concatenate(others), minlength=rows)


@dataclass
class Model:
    languages: list[str]
    column: np.ndarray  # of each gram code; the number of known grams for all others
    weights: np.ndarray  # grams by languages

    def scores(self, texts: list[str]) -> np.ndarray:
        """Regression values, texts by languages."""
        out = np.zeros((len(texts), len(self.languages)))
        start = 0
        clean = [normal(t) for t in texts]
        while start < len(texts):
            end, size = start + 1, len(clean[start])
            while end < len(texts) and size + len(clean[end]) <= 1 << 19:
                size += len(clean[end])
                end += 1
            for first in range(0, max(1, len(clean[start])) if end == start + 1 else 1, 1 << 19):
                part = [clean[start][first : first + (1 << 19)]] if end == start + 1 else clean[start:end]
                codes, segment, owner, length = segments(part)
                m, size = presence(codes, segment, self.column, len(owner), len(self.weights))
                value = m.astype(np.float32) @ self.weights / np.sqrt(np.maximum(size, 1))[:, None]
                total = np.zeros((len(part), len(self.languages)))
                np.add.at(total, owner, value * length[:, None])
                out[start:end] += total
            out[start:end] /= np.maximum([len(c) for c in clean[start:end]], 1)[:, None]
            start = end
        return out


def labelled(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, doc_id, text, h of the rows to learn from; h is a hash of id and text."""
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    return own.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("h", F.xxhash64("doc_id", "text"))


def facts(own: DataFrame) -> DataFrame:
    """lang, h, n of all rows of labelled() with a letter; n is the number of segments. Written once, without texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([max(1, -(-len(normal(t)) // SEGMENT)) if has_letter(t) else 0 for t in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], names=["lang", "h", "n"])

    small_batches(own.sparkSession)
    return materialise(own.select("lang", "h", "text").mapInArrow(run, "lang string, h long, n long").filter("n > 0"))


def sample(docs: DataFrame, learn: Column, **columns: str) -> DataFrame:
    """lang, segments of the texts that landmarks are drawn from: see chosen()."""
    own = labelled(docs, learn, **columns)
    return chosen(own, facts(own))


def chosen(own: DataFrame, known: DataFrame) -> DataFrame:
    """lang, segments: of each language the texts with the smallest hashes, each once.

    Hashes alone are ranked, after a language with many distinct texts has been thinned by them, so no
    task gets more than some thousand rows of a language, and whole texts are read only of chosen rows.
    """
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE_ROWS)
    sizes = sizes.withColumn("each", F.greatest(F.lit(1), F.least(F.lit(PER_LANGUAGE), (F.lit(SAMPLE_ROWS) / F.count("*").over(Window.partitionBy())).cast("int"))))
    bound = F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(3.0) * F.col("each") / F.col("n")) - F.lit(2.0**63)
    sizes = sizes.select("lang", "each", bound.alias("bound"))  # SAMPLE_ROWS rows at most
    thin = known.select("lang", "h").join(F.broadcast(sizes), "lang").filter(F.col("h").cast("double") <= F.col("bound")).distinct()
    ranked = thin.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter("k <= each")
    texts = own.join(F.broadcast(ranked.select("lang", "h")), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))  # SAMPLE_ROWS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [(lang, spread(t)) for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if has_letter(t)]
            yield table({"lang": [k[0] for k in kept], "segments": [k[1] for k in kept]}, pa.schema([("lang", pa.string()), ("segments", pa.list_(pa.binary()))]))

    return texts.select("lang", "text").mapInArrow(run, "lang string, segments array<binary>")


def train(rows: list[tuple[str, str]]) -> Model:
    """rows: (language, text)."""
    return train_segments([(a, spread(t)) for a, t in rows if has_letter(t)])


def train_segments(rows: list[tuple[str, list[bytes]]]) -> Model:
    """rows: (language, segments of a text), all of which are learned from."""
    basis = Basis.of(rows)
    pieces = [(a, bytes(p)) for a, ps in rows for p in ps]
    count = Counter(a for a, _ in pieces)
    sums = Sums(basis, dict(sorted(count.items())))
    for i in range(0, len(pieces), BLOCK):
        sums.add(*zip(*pieces[i : i + BLOCK], strict=True))
    return sums.solve(sums.left, sums.right)


@dataclass
class Basis:
    """The landmarks, which span the space that all rows are learned in."""

    marks: list[bytes]
    column: np.ndarray  # of each gram code; the number of known grams for all others
    grams: np.ndarray  # landmarks by known grams, 0/1
    size: np.ndarray  # distinct grams of each landmark

    @classmethod
    def of(cls, rows: list[tuple[str, list[bytes]]]) -> Basis:
        pieces = sorted((a, bytes(p)) for a, ps in rows for p in ps)
        if not pieces:
            return cls([], np.zeros(SPACE, np.int32), np.zeros((0, 0), np.float32), np.zeros(0))
        languages = sorted({a for a, _ in pieces})
        number = {a: i for i, a in enumerate(languages)}
        label = np.array([number[a] for a, _ in pieces])
        rng = np.random.default_rng(7)
        each = max(1, LANDMARKS // len(languages))
        marks = [pieces[m][1] for k in range(len(languages)) for m in rng.permutation(np.flatnonzero(label == k))[:each].tolist()]
        codes, segment, owner, _ = segments(marks)
        starts = np.searchsorted(segment, np.arange(len(owner) + 1))
        seen = np.unique(np.concatenate([g for m in range(len(marks)) for g in grams(codes[starts[m] : starts[m + 1]])]))
        column = np.full(SPACE, len(seen), np.int32)
        column[seen] = np.arange(len(seen))
        parts = [cls._presence(marks[i : i + 256], column, len(seen)) for i in range(0, len(marks), 256)]
        return cls(marks, column, np.concatenate([p for p, _ in parts]), np.concatenate([n for _, n in parts]))

    @staticmethod
    def _presence(part: list[bytes], column: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray]:
        codes, segment, owner, _ = segments(part)
        p, size = presence(codes, segment, column, len(owner), known)
        return p.astype(np.float32), np.maximum(size, 1).astype(np.float64)

    def kernel(self, part: list[bytes]) -> np.ndarray:
        """Kernel of segments with landmarks. Shared grams are whole numbers, so no order of summing changes a bit."""
        p, size = self._presence(part, self.column, self.grams.shape[1])
        return (p @ self.grams.T).astype(np.float64) / np.sqrt(size[:, None] * self.size)


class Sums:
    """Sums of the normal equations over segments, each language weighing the same.

    Kernel values are rounded to whole numbers of a unit that keeps their sums below 2^53, so they are exact: rows can be cut
    and ordered in any way.
    """

    def __init__(self, basis: Basis, count: dict[str, int]) -> None:
        self.basis, self.count = basis, count
        self.number = {a: i for i, a in enumerate(count)}
        self.least = min(count.values(), default=1)
        self.root = np.sqrt(self.least / np.array([*count.values()], np.float64))
        self.left_unit, self.right_unit = (2.0 ** min(26, (53 - int(n).bit_length()) // k) for n, k in ((self.least * len(count) + sum(count.values()) // 2**20 + 1, 2), (max(count.values(), default=1), 1)))
        self.left, self.right = np.zeros((len(basis.marks), len(basis.marks))), np.zeros((len(basis.marks), len(count)))

    def add(self, labels: Sequence[str], part: Sequence[bytes]) -> None:
        k = self.basis.kernel(list(part))
        label = np.array([self.number[a] for a in labels])
        u = np.rint(k * self.root[label][:, None] * self.left_unit)
        self.left += u.T @ u
        self.right += np.rint(k * self.right_unit).T @ (label[:, None] == np.arange(len(self.count))).astype(np.float64)

    def solve(self, left: np.ndarray, right: np.ndarray) -> Model:
        b = self.basis
        if not b.marks:
            return Model([], b.column, b.grams)
        base = b.grams / np.sqrt(b.size)[:, None].astype(np.float32)
        left = left / (self.left_unit**2 * self.least) + RIDGE * (base @ base.T) + 1e-8 * np.eye(len(b.marks))
        alpha = np.linalg.solve(left, right / self.right_unit / np.array([*self.count.values()]))
        return Model([*self.count], b.column, (base.T @ alpha).astype(np.float32))


def fit(docs: DataFrame, learn: Column, per_text: int | None = SEGMENTS, **columns: str) -> Model:
    """The model of all rows to learn from, with all segments of a text or per_text of them, spread evenly.

    Only landmarks, languages (SAMPLE_ROWS at most) and sums of the size of the model reach the driver.
    """
    own = labelled(docs, learn, **columns)
    known = facts(own)
    basis = Basis.of([(r["lang"], r["segments"]) for r in chosen(own, known).collect()])  # SAMPLE_ROWS rows at most
    size = F.col("n") if per_text is None else F.least("n", F.lit(per_text))
    each = known.groupBy("lang", "h").agg(F.min(size).alias("n"), F.count("*").alias("copies"))
    totals = each.groupBy("lang").agg(F.sum("n").alias("n"), F.max("copies").alias("copies")).orderBy(F.desc("n"), "lang").limit(SAMPLE_ROWS).collect()
    count = {r["lang"]: r["n"] for r in sorted(totals, key=lambda r: r["lang"])}
    if not basis.marks:
        return Sums(basis, count).solve(np.zeros(0), np.zeros(0))
    if any(r["copies"] > 1 for r in totals):  # repeated rows are learned once; texts are shuffled only where there are some
        own = own.select("lang", "h", "text", "doc_id").distinct()
    width, spark = len(basis.marks), docs.sparkSession
    sent = spark.sparkContext.broadcast((basis, count))  # its size depends on the bounds of landmarks and languages only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, labels, parts = Sums(*sent.value), [], []
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if lang in sums.number and has_letter(text):
                    pieces = spread(text, per_text)
                    labels += [lang] * len(pieces)
                    parts += pieces
                while len(parts) >= BLOCK:
                    sums.add(labels[:BLOCK], parts[:BLOCK])
                    del labels[:BLOCK], parts[:BLOCK]
        if parts:
            sums.add(labels, parts)
        rows = np.concatenate([sums.left, sums.right], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["i", "sums"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found[i] = found.get(i, 0) + np.frombuffer(raw)
        yield pa.RecordBatch.from_arrays([pa.array([*found], pa.int32()), pa.array([r.tobytes() for r in found.values()], pa.binary())], names=["i", "sums"])

    small_batches(spark)
    parts = own.select("lang", "text").mapInArrow(run, "i int, sums binary")
    rows = parts.repartition(min(width, partitions(spark)), "i").mapInArrow(total, "i int, sums binary").collect()  # a row a landmark
    whole = np.zeros((width, width + len(count)))
    for r in rows:
        whole[r["i"]] = np.frombuffer(r["sums"])
    return Sums(basis, count).solve(whole[:, :width], whole[:, width:])


def chances(f: np.ndarray) -> np.ndarray:
    """A softmax of regression values, texts by languages."""
    p = np.exp(SHARPNESS * (f - f.max(axis=1, keepdims=True)))
    return p / p.sum(axis=1, keepdims=True)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The kept columns with the predicted language and its score (a softmax of the regression values)."""
    if set(names) & set(keep):
        raise ValueError("a kept column has the name of a result")
    # by place, as names with dots can't be passed to Python
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size depends on the sample's bounds only
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            texts = b.column(at).to_pylist()
            ok = [i for i, t in enumerate(texts) if m.languages and has_letter(t)]
            best, scores = ["und"] * len(texts), np.zeros(len(texts))
            if ok:
                p = chances(m.scores([texts[i] for i in ok]))
                for j, (i, k) in enumerate(zip(ok, p.argmax(axis=1).tolist())):
                    best[i], scores[i] = m.languages[k], p[j, k]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(best, pa.string()), pa.array(scores)], names=[f"c{i}" for i in range(at)] + ["lang", "score"])

    small_batches(docs.sparkSession)
    schema = T.StructType([*own.schema.fields[:at], T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    return own.mapInArrow(run, schema).toDF(*keep, *names)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo folds, is 0. A null id is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    model = fit(docs, ~held_out())
    out = predict(docs, model)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "lang_pred", "score")


def threshold(docs: DataFrame, model: Model, learn: Column) -> float:
    """A quarter of the way from chance to the lowest score among all labelled texts of SHORT bytes or more that `learn` names."""
    if len(model.languages) < 2:
        return 0.0
    texts = labelled(docs, learn).filter(F.octet_length("text") >= SHORT).select("text")
    lowest = predict(texts, model, keep=()).filter("lang_pred <> 'und'").agg(F.min("score")).first()[0]
    chance = 1 / len(model.languages)
    return 0.0 if lowest is None else chance + (lowest - chance) / 4


def accept(docs: DataFrame, least: float | None = None) -> DataFrame:
    """docs without texts that have no learned language; a null lang of a row that stays is filled in.

    Rejected are null texts, texts without a letter, and texts of SHORT bytes or more whose score is below
    `least`, which is set by threshold() on all held-out labelled rows unless given. Whole texts of all other labelled
    rows are learned from. Where nothing could be learned, all texts with a letter stay.
    """
    model = fit(docs, ~held_out(), per_text=None)
    columns = docs.columns
    if not model.languages:
        at = columns.index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([has_letter(t) for t in b.column(at).to_pylist()], pa.bool_()))

        small_batches(docs.sparkSession)
        own = docs.toDF(*[f"c{i}" for i in range(len(columns))])
        return own.mapInArrow(run, own.schema).toDF(*columns)
    if least is None:
        least = threshold(docs, model, held_out())
    mark = "_" * (1 + max(map(len, columns)))  # longer than any name of docs
    names = f"{mark}lang", f"{mark}score"
    out = predict(docs, model, keep=tuple(columns), names=names)
    kept = out.filter((F.col(names[0]) != "und") & ((F.octet_length("text") < SHORT) | (F.col(names[1]) >= least)))
    return kept.withColumn("lang", F.coalesce("lang", names[0])).select(*[f"`{c}`" for c in columns])
