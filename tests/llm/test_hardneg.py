"""Dual-tree search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from warpline.llm import hardneg, registry

SF = "/root/testdata/sf0.001"


def brute(rows, anchor=lambda i: i % 50 == 0, low=50, high=95):
    """rows: id -> (label, integer vector)."""
    out = []
    for a, (label, v) in rows.items():
        if not anchor(a):
            continue
        score = {i: sum(int(x) * int(y) for x, y in zip(v, w)) for i, (_, w) in rows.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if rows[i][0] == label][:5]:
            fits = [i for i in order if rows[i][0] != label and low * score[p] <= 100 * score[i] <= high * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fits[:3])]
    return sorted(out)


def integers(table):
    out = {}
    for r in table.collect():
        label = (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label
        out[r.vec_id] = (label, [int(np.floor(256 * float(x))) for x in r.embedding])
    return out


def test_op12(spark):
    rows = integers(spark.read.parquet(f"{SF}/embeddings.parquet"))
    got = registry.op12_hard_negatives(spark, SF)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows) != []


def frame(spark, rows):
    return spark.createDataFrame([(i, lab, [int(x) for x in v]) for i, (lab, v) in rows.items()], "id long, label long, vec array<int>")


@pytest.mark.parametrize("seed", range(3))
def test_many_blocks_batches_and_ties(spark, monkeypatch, seed):
    """Small blocks, leaves, samples and batches; small components, so ties are many; a hot vector stands for a third of the rows."""
    for name, value in (("SAMPLE", 20), ("CELL", 4), ("BLOCK", 40), ("LEAF", 6), ("VALUES", 20)):
        monkeypatch.setattr(hardneg, name, value)
    rnd = np.random.default_rng(seed)
    rows = {int(i): (int(rnd.integers(0, 3)), [2, 1, 0, 1] if i % 3 == 0 else rnd.integers(-3, 5, 4).tolist()) for i in range(300)}
    got = hardneg.mine(frame(spark, rows), F.col("id") % 25 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 25 == 0)


def test_whole_groups_are_pruned():
    """Far apart clusters: the search looks at few of all pairs of nodes, and intervals hold all products."""
    rnd = np.random.default_rng(0)
    base = rnd.normal(size=(8, 16)) * 300
    points = np.floor(np.concatenate([b + rnd.normal(size=(200, 16)) for b in base]))
    t, a = hardneg.tree(points, 16), hardneg.tree(points[::10], 8)
    assert sorted(t.order) == list(range(len(points)))
    products = points[::10][a.order] @ points[t.order].T
    low = np.sort(products, axis=1)[:, -5]
    x, y, seen = hardneg.surviving(a, t, hardneg._fold(a, low, True), np.full(len(a.start), np.inf))
    kept = np.zeros(products.shape, bool)
    for i, j in zip(x, y):
        kept[a.start[i] : a.end[i], t.start[j] : t.end[j]] = True
    assert kept[products >= low[:, None]].all() and kept.mean() < 0.3
    assert seen < len(a.start) * len(t.start) / 3


def test_defined_cases(spark):
    nan, inf, none = float("nan"), float("inf"), None
    rows = [(0, 1, [1.0, 0.5]), (50, 1, [1.0]), (1, 1, [0.75, 0.5]), (2, 2, [0.5, 0.5]), (2, 3, [0.1, 0.5]), (2, 2, [0.5, 0.5]), (3, 2, [0.5, nan]), (4, 2, [inf, 0.0]), (5, 2, [none, 0.0]), (6, none, [0.5, 0.5]), (8, 2, none), (none, 2, [0.5, 0.5]), (9, 2, []), (10, 2, [1e30, 0.0])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, id string, vec int")
    clean = hardneg.from_embeddings(table)
    assert {r.id: (r.label, r.vec) for r in clean.collect()} == {0: (2, [256, 128]), 50: (1, [256]), 1: (1, [192, 128]), 2: (2, [128, 128]), 9: (2, [])}
    got = hardneg.mine(clean, F.col("id") % 50 == 0).collect()
    padded = {i: (lab, [*v, *[0] * (2 - len(v))]) for i, (lab, v) in {0: (2, [256, 128]), 50: (1, [256]), 1: (1, [192, 128]), 2: (2, [128, 128]), 9: (2, [])}.items()}
    assert sorted(map(tuple, got)) == brute(padded) != []
    assert hardneg.mine(clean.limit(0), F.col("id") % 50 == 0).count() == hardneg.mine(clean, F.lit(False)).count() == 0
    assert hardneg.mine(clean.filter("id = 0"), F.lit(True)).count() == 0
