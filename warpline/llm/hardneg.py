"""Hard-negative mining by dual-tree search over integer vectors.

Anchors and candidates both stand in ball trees. For two nodes with centres a and c and radii r and s, every inner
product between them lies within <a, c> +- (|a| s + |c| r + r s). A pair of nodes is dropped, and with it a whole
group of anchors against a whole group of candidates, when that interval lies outside what any of its
anchors still wants; what is left at the leaves is scored exactly by matrix products of integers in doubles.

Two searches use this: the best rows of an anchor's own label, and, for each of these positives, the best rows of other labels
whose score lies in a window given by the positive's score.

Spark: candidates are dealt by range over cells (balls of a tree on SAMPLE rows) and their id, so a block of BLOCK rows
is mostly one cell. Anchors go in batches of at most about VALUES numbers each, the only thing that is broadcast; each batch meets
all candidates without shuffling them, and a task passes on at most k rows a wanted list. Scores within the sample give every
search a lower bound to begin with. Batches are stored one by one in the shared folder.

Defined cases: rows with a null id or label, a null vector, a null or non-finite component, or one of 2^21 or more (a
score could then be inexact) take no part. Shorter vectors count as filled up with zeros. Of rows with one id the smallest (label, vector)
counts. Ties of score go to the smaller id. No anchors, no positives or no rows in the window give no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warpline.llm.common import materialise, partitions, shared_dir

SAMPLE, CELL, BLOCK, LEAF, VALUES = 4096, 64, 8192, 64, 1 << 22
LARGEST = float(1 << 21)
NONE = -(2.0**62)  # below every score


class Tree(NamedTuple):
    """A ball tree: node i holds the points start[i]:end[i] of order; left and right are 0 at leaves."""

    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    norm: np.ndarray


def tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """Halves along the line between two far points; equal points are halved by place, so leaves stay small."""
    order = np.arange(len(points))
    spans, kids, centres, radii = [(0, len(points))], [], [], []
    at = 0
    while at < len(spans):
        s, e = spans[at]
        own = points[order[s:e]]
        c = own.mean(axis=0) if e > s else np.zeros(points.shape[1])
        d = np.sqrt(((own - c) ** 2).sum(axis=1)) if e > s else np.zeros(1)
        centres.append(c)
        radii.append(d.max())
        if e - s <= leaf:
            kids.append((0, 0))
        else:
            far = own[d.argmax()]
            other = own[((own - far) ** 2).sum(axis=1).argmax()]
            m = (e - s) // 2
            order[s:e] = order[s:e][np.argpartition(own @ (other - far), m)]
            kids.append((len(spans), len(spans) + 1))
            spans += [(s, s + m), (s + m, e)]
        at += 1
    span, kid, centre = np.array(spans), np.array(kids), np.array(centres)
    return Tree(order, span[:, 0], span[:, 1], kid[:, 0], kid[:, 1], centre, np.array(radii), np.sqrt((centre**2).sum(axis=1)))


def _fold(t: Tree, values: np.ndarray, least: bool) -> np.ndarray:
    """Minimum (or maximum) over the points of each node; values are in the tree's order."""
    out = np.empty(len(t.start))
    f = np.minimum if least else np.maximum
    for i in range(len(out) - 1, -1, -1):
        out[i] = f(out[t.left[i]], out[t.right[i]]) if t.left[i] else f.reduce(values[t.start[i] : t.end[i]])
    return out


def surviving(a: Tree, c: Tree, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(anchor leaf, candidate leaf) pairs whose interval meets [low, high] of the anchor node, and the number of pairs looked at."""
    x, y = np.zeros(1, np.int64), np.zeros(1, np.int64)
    out, seen = [], 0
    while len(x):
        seen += len(x)
        mid = np.einsum("ij,ij->i", a.centre[x], c.centre[y])
        spread = a.norm[x] * c.radius[y] + c.norm[y] * a.radius[x] + a.radius[x] * c.radius[y] + 0.5  # 0.5: more than rounding adds
        keep = (mid + spread >= low[x]) & (mid - spread <= high[x])
        x, y = x[keep], y[keep]
        done = (a.left[x] == 0) & (c.left[y] == 0)
        out.append((x[done], y[done]))
        x, y = x[~done], y[~done]
        by_a = (a.left[x] > 0) & ((c.left[y] == 0) | (a.radius[x] >= c.radius[y]))
        u, v, p, q = x[by_a], y[by_a], x[~by_a], y[~by_a]
        x = np.concatenate([a.left[u], a.right[u], p, p])
        y = np.concatenate([v, v, c.left[q], c.right[q]])
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out]), seen


class Wanted:
    """Lists that anchors want: the k best scores within [low, high] among rows of their own (same) or of other labels."""

    def __init__(self, anchors: Tree, owner: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, floor: np.ndarray, k: int):
        """owner: place of the anchor in its tree's order, ascending; floor: a score below which no row of the list can lie."""
        self.tree, self.owner, self.same, self.low, self.high, self.k = anchors, owner, same, low, high, k
        self.floor = np.maximum(low, floor)
        self.score, self.id = np.full((len(owner), k), NONE), np.zeros((len(owner), k), np.int64)
        self.first = np.searchsorted(owner, np.arange(len(anchors.order) + 1))

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        need = np.maximum(self.floor, self.score[:, -1])
        low, high = np.full(len(self.tree.order), np.inf), np.full(len(self.tree.order), -np.inf)
        np.minimum.at(low, self.owner, need)
        np.maximum.at(high, self.owner, self.high)
        return _fold(self.tree, low, True), _fold(self.tree, high, False)

    def take(self, lists: slice, scores: np.ndarray, ok: np.ndarray, ids: np.ndarray) -> None:
        """Merge scores (a row a list) into the best of the lists."""
        need = np.maximum(self.floor[lists], self.score[lists, -1])
        found = ok & (scores >= need[:, None]) & (scores <= self.high[lists, None])
        r, c = np.nonzero(found)
        if not len(r):
            return
        n = scores.shape[0]
        old = np.repeat(np.arange(n), self.k)
        row = np.concatenate([old, r])
        s = np.concatenate([self.score[lists].ravel(), scores[r, c]])
        i = np.concatenate([self.id[lists].ravel(), ids[c]])
        by = np.lexsort((i, -s, row))
        row, s, i = row[by], s[by], i[by]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        top = rank < self.k
        self.score[lists], self.id[lists] = s[top].reshape(n, self.k), i[top].reshape(n, self.k)


def search(wanted: Wanted, points: np.ndarray, labels: np.ndarray, ids: np.ndarray, vectors: np.ndarray, of_label: np.ndarray, of_id: np.ndarray) -> None:
    """Fill the lists from the anchors (points, labels, ids in their tree's order) against a block of rows."""
    c = tree(vectors)
    rows, row_label, row_id = vectors[c.order], of_label[c.order], of_id[c.order]
    x, y, _ = surviving(wanted.tree, c, *wanted.bounds())
    by = np.argsort(x, kind="stable")
    x, y = x[by], y[by]
    for node in np.unique(x):
        leaves = y[np.searchsorted(x, node) : np.searchsorted(x, node, "right")]
        at = np.concatenate([np.arange(c.start[v], c.end[v]) for v in np.sort(leaves)])
        s, e = wanted.tree.start[node], wanted.tree.end[node]
        lists = slice(wanted.first[s], wanted.first[e])
        own = wanted.owner[lists]
        scores = (points[s:e] @ rows[at].T)[own - s]
        alike = labels[own][:, None] == row_label[at][None, :]
        ok = (alike if wanted.same else ~alike) & (ids[own][:, None] != row_id[at][None, :])
        wanted.take(lists, scores, ok, row_id[at])


def _matrix(vectors: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of the list column as doubles, filled up with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat, n = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(n), dims))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def quantised(table: DataFrame, id_col: Column, label: Column, vector: Column, scale: float) -> DataFrame:
    """id, label, vec of the rows that take part, one an id; components become floor(scale * x)."""
    rows = table.select(id_col.cast("long").alias("id"), label.cast("long").alias("label"), F.transform(vector, lambda x: F.lit(scale) * x.cast("double")).alias("x"))
    fine = F.forall("x", lambda x: F.coalesce(F.abs(x) < F.lit(LARGEST), F.lit(False)))  # a comparison with nan is false here
    fine = fine & ~F.exists("x", lambda x: F.isnan(x))
    rows = rows.filter("id is not null and label is not null and x is not null").filter(fine)
    own = F.min(F.struct("label", F.transform("x", lambda x: F.floor(x).cast("int")).alias("vec")))
    return rows.groupBy("id").agg(own.alias("r")).select("id", "r.label", "r.vec")


def _collected(rows: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, matrix) of a bounded table, in order of id."""
    t = rows.orderBy("id").toArrow()
    return t.column("id").to_numpy(), t.column("label").to_numpy(), _matrix(t.column("vec"), dims)


def _dealt(rows: DataFrame, centres: np.ndarray, dims: int) -> DataFrame:
    """rows by cell: the nearest of the centres."""
    half = (centres**2).sum(axis=1) / 2
    schema = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("vec", pa.list_(pa.int32())), ("cell", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = (_matrix(b.column(2), dims) @ centres.T - half).argmax(axis=1) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2).cast(schema.field(2).type), pa.array(cell, pa.int32())], schema=schema)

    out = rows.select("id", "label", "vec").mapInArrow(run, "id long, label long, vec array<int>, cell int")
    return out.repartitionByRange(partitions(rows.sparkSession), "cell", "id").sortWithinPartitions("cell", "id")


FOUND = pa.schema([("list", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _scan(rows: DataFrame, batch, dims: int, k: int) -> DataFrame:  # noqa: ANN001
    """(list, id, score): each task's k best rows of each wanted list; batch is a broadcast of all that describes the lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, labels, ids, t, owner, same, low, high, floor = batch.value
        points = points.astype(np.float64)
        wanted = Wanted(t, owner, same, low, high, floor, k)
        held, n = [], 0

        def done() -> None:
            v, lab, i = (np.concatenate(x) for x in zip(*held))
            search(wanted, points, labels, ids, v, lab, i)

        for b in batches:
            for s in range(0, b.num_rows, BLOCK):
                part = b.slice(s, BLOCK)
                held.append((_matrix(part.column(2), dims), part.column(1).to_numpy(zero_copy_only=False), part.column(0).to_numpy(zero_copy_only=False)))
                n += part.num_rows
                if n >= BLOCK:
                    done()
                    held, n = [], 0
        if n:
            done()
        q, c = np.nonzero(wanted.score > NONE)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(wanted.id[q, c]), pa.array(wanted.score[q, c].astype(np.int64))], schema=FOUND)

    found = rows.select("id", "label", "vec").mapInArrow(run, "list long, id long, score long")
    best = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k)


def _floor(t: Tree, points: np.ndarray, labels: np.ndarray, ids: np.ndarray, owner: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int, sample: tuple) -> np.ndarray:
    """The k-th best score of each list within the sample, whose rows are rows of the table."""
    w = Wanted(t, owner, same, low, high, np.full(len(owner), NONE), k)
    search(w, points, labels, ids, sample[2], sample[1], sample[0])
    return w.score[:, -1]


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: id, label, vec (see quantised). An anchor's positives are its best other rows of the same label; a positive's negatives the
    best rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    spark, sc = rows.sparkSession, rows.sparkSession.sparkContext
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = materialise(rows.withColumn("is_anchor", is_anchor))
    n, anchors, dims = rows.agg(F.count("*"), F.count_if("is_anchor"), F.max(F.size("vec"))).first()
    if not n or not anchors:
        return empty
    dims = max(1, dims)
    sample = _collected(rows.select("id", "label", "vec").orderBy(F.xxhash64("id"), "id").limit(SAMPLE), dims)
    cells = tree(sample[2], CELL)
    dealt = materialise(_dealt(rows, cells.centre[cells.left == 0], dims))
    batches = -(-anchors * dims // VALUES)
    parts = []
    for i in range(batches):
        mine_ = rows.filter(F.col("is_anchor") & (F.pmod(F.xxhash64("id"), F.lit(batches)) == i))
        ids, labels, points = _collected(mine_.select("id", "label", "vec"), dims)
        if not len(ids):
            continue
        t = tree(points)
        ids, labels, points = ids[t.order], labels[t.order], points[t.order]

        def best(owner: np.ndarray, same: bool, lo: np.ndarray, hi: np.ndarray, k: int, held=(points, labels, ids, t)):  # noqa: ANN001, ANN202
            points, labels, ids, t = held
            floor = _floor(t, points, labels, ids, owner, same, lo, hi, k, sample)
            b = sc.broadcast((points.astype(np.int32), labels, ids, t, owner, same, lo, hi, floor))
            return _scan(dealt, b, dims, k), b

        owner = np.arange(len(ids))
        found, b1 = best(owner, True, np.full(len(ids), NONE), np.full(len(ids), np.inf), positives)
        pos = found.toArrow().to_pandas().sort_values(["list", "rank"])
        b1.destroy()
        if not len(pos):
            continue
        owner, pid, p = pos["list"].to_numpy(), pos["id"].to_numpy(), pos["score"].to_numpy()
        lo, hi = -(-low * p // 100).astype(np.float64), (high * p // 100).astype(np.float64)  # whole scores: rounded inwards
        found, b2 = best(owner, False, lo, hi, negatives)
        path = shared_dir(spark)
        about = spark.createDataFrame(pa.table({"list": np.arange(len(owner)), "anchor_id": ids[owner], "positive_id": pid, "positive_score": p}))
        # as many rows as lists in the batch
        out = found.join(F.broadcast(about), "list").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.write.parquet(path)
        b2.destroy()
        parts.append(path)
    return spark.read.schema(empty.schema).parquet(*parts) if parts else empty


def from_embeddings(table: DataFrame) -> DataFrame:
    """id, label, vec of the table embeddings: ids divisible by 7 have the next label, components are floor(256 x)."""
    i, label = F.col("vec_id"), F.col("label").cast("long")
    return quantised(table, i, F.when(i % 7 == 0, (label + 1) % 10).otherwise(label), F.col("embedding"), 256.0)
