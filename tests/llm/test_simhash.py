import random

import numpy as np
import pytest
import xxhash

from warpline.llm import simhash
from warpline.llm.components import components


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints, ids):
    low = dict(zip(ids, ids))
    changed = True
    while changed:
        changed = False
        for i, a in zip(ids, prints):
            for j, b in zip(ids, prints):
                if (a ^ b).bit_count() <= 4 and low[j] < low[i]:
                    low[i], changed = low[j], True
    return low


@pytest.mark.parametrize("shard", [1024, 3])
def test_against_brute_force(make_docs, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    rnd = random.Random(4)
    texts = ["", None, " \n", "one", "One", "a b c d", "A B\tC D"]
    base = ["".join(rnd.choice("xyz") for _ in range(5)) for _ in range(200)]
    while len(texts) < 50:
        texts.append(" ".join(rnd.choice(base) for _ in range(rnd.randint(1, 120))))
        words = texts[-1].split()
        words[rnd.randrange(len(words))] = "edit"
        texts.append(" ".join(words))
        texts.append(texts[-1])
    ids = list(range(100, 100 + len(texts)))
    rnd.shuffle(ids)
    prints = [brute_print(t) for t in texts]
    want = brute_components(prints, ids)
    got = {r.doc_id: r for r in simhash.near_duplicates(make_docs(texts, ids)).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in zip(ids, prints)}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {r.doc_id for r in simhash.keep_one(make_docs(texts, ids)).collect()} == set(want.values())


@pytest.mark.parametrize("radius", [0, 4, 9])
def test_tree_finds_all(radius):
    r = np.random.default_rng(radius)
    f = r.integers(0, 2**64, 400, dtype=np.uint64)
    f = np.unique(np.concatenate([f, f ^ np.uint64(0b1111), f ^ np.uint64(1 << 63)]))
    a, b = simhash.BKTree(f).search(f, radius)
    want = np.argwhere(np.bitwise_count(f[:, None] ^ f[None, :]) <= radius)
    assert sorted(zip(a.tolist(), b.tolist())) == sorted(map(tuple, want.tolist()))


def test_empty_and_null_ids(make_docs):
    assert simhash.near_duplicates(make_docs([])).count() == 0
    rows = simhash.near_duplicates(make_docs(["a b c d e", "a b c d e", None], [None, 5, None])).collect()
    assert len(rows) == 3 and {r.component_id for r in rows if r.fingerprint != "0" * 16} == {5}
    assert simhash.keep_one(make_docs(["a", "a"], [None, None])).count() == 2


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(7, 7), (9, 8), (9, 8)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 540)}, 8: 8, 9: 8}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_groups(texts, ids):
    """Smallest id of each group of chained texts with a Jaccard similarity of 0.8 or more, by all pairs."""
    low, sets = dict(zip(ids, ids)), [shingles(t) for t in texts]
    near = [(i, j) for i, a in zip(ids, sets) for j, b in zip(ids, sets) if i < j and len(a & b) >= 0.8 * len(a | b) - 1e-9]
    changed = True
    while changed:
        changed = False
        for i, j in near:
            least = min(low[i], low[j])
            changed |= low[i] != low[j]
            low[i] = low[j] = least
    return low


def test_wide_fingerprint_by_plain_integers():
    rnd = random.Random(3)
    full, factor = 2**64 - 1, 0xBF58476D1CE4E5B9
    for n in (1, 4, 5, 9, 300):
        text = " ".join(rnd.choice("abcdefg") * rnd.randint(1, 3) for _ in range(n))
        hashes = []
        for g in shingles(text):
            wide = 0
            for i in range(4):
                x = (xxhash.xxh3_64_intdigest(g) + i * 0x9E3779B97F4A7C15) & full
                x ^= x >> 30
                x = x * factor & full
                wide |= (x ^ x >> 27) << 64 * i
            hashes.append(wide)
        want = sum(1 << b for b in range(256) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
        got = simhash.wide_fingerprint(simhash.shingle_hashes(text.encode()))
        assert sum(int(w) << 64 * i for i, w in enumerate(got.tolist())) == want


def jaccard(a, b):
    s, t = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(s & t) / len(s | t)


@pytest.mark.parametrize("shard", [1024, 8])
def test_near_copies_go_and_others_stay(make_docs, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(2000)]
    texts, origin = [], []
    for k in range(60):
        words = [rnd.choice(base) for _ in range(rnd.randint(60, 400))]
        texts.append(" ".join(words))
        origin.append(k)
        for _ in range(rnd.randint(0, 3) + 40 * (k == 7)):
            copy = list(words)
            for _ in range(max(1, len(words) // 80)):
                copy[rnd.randrange(len(copy))] = "edit"
            texts.append(" ".join(copy).upper())
            origin.append(k)
    first = {}
    for i, k in enumerate(origin):
        first.setdefault(k, i)
    kept = {r.doc_id for r in simhash.keep_one_similar(make_docs(texts)).collect()}
    assert set(first.values()) <= kept  # clean documents and one of each group
    extra = [i for i in kept - set(first.values()) if jaccard(texts[i].lower(), texts[first[origin[i]]]) >= 0.8]
    assert len(extra) <= 0.03 * len(texts)


def chain(n, step, rnd):
    """Texts that drift: neighbours share more than 0.8 of their shingles, far ones less."""
    words = [f"w{rnd.randrange(5000)}" for _ in range(300)]
    out = []
    for _ in range(n):
        out.append(" ".join(words))
        words = words[step:] + [f"w{rnd.randrange(5000)}" for _ in range(step)]
    return out


@pytest.mark.parametrize("shard", [1024, 3])
def test_groups_against_all_pairs(make_docs, monkeypatch, shard):
    """Chains of drifting copies, and a template whose texts are alike at about 0.7: equal to brute force where shards miss none."""
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "RECALL", 1 - 1e-7)
    rnd = random.Random(9)
    base = [f"t{rnd.randrange(9999)}" for _ in range(200)]
    texts = chain(25, 25, rnd) + chain(10, 35, rnd) + chain(6, 45, rnd)
    for _ in range(25):
        copy = list(base)
        at = rnd.randrange(150)
        copy[at : at + 36] = [f"u{rnd.randrange(9999)}" for _ in range(36)]
        texts.append(" ".join(copy))
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    got = {r.doc_id for r in simhash.keep_one_similar(make_docs(texts, ids)).collect()}
    assert got == set(near_groups(texts, ids).values())


def test_pairs_at_the_threshold(spark, make_docs):
    """Recall over pairs at a similarity of 0.80 to 0.82 among other texts, and no false removal."""
    rnd = random.Random(11)
    texts = []
    for _ in range(100):
        words = [f"v{rnd.randrange(20000)}" for _ in range(rnd.randint(150, 400))]
        copy, at = list(words), rnd.randrange(40)
        k = int(len(words) * 0.19 / 1.8) - 3
        copy[at : at + k] = [f"x{rnd.randrange(20000)}" for _ in range(k)]
        texts += [" ".join(words), " ".join(copy)]
    want = near_groups(texts, range(len(texts)))
    kept = {r.doc_id for r in simhash.keep_one_similar(make_docs(texts)).collect()}
    near = {i for i in want if want[i] != i}
    assert len(near) > 60 and len(near - kept) >= 0.95 * len(near)
    assert set(range(len(texts))) - kept <= near


def test_rows_of_one_id_are_judged_apart(make_docs):
    long = " ".join(f"w{i}" for i in range(40))
    docs = make_docs([long, "another text", long, long + " x", "b", "b", "b"], [5, 5, 7, 5, 9, 9, 3])
    got = sorted((r.doc_id, r.text) for r in simhash.keep_one_similar(docs).collect())
    assert [t for _, t in got if t == "another text"] and sum(t.startswith("w0 ") for _, t in got) == 1
    assert [i for i, t in got if t == "b"] == [3]
    assert simhash.keep_one_similar(make_docs(["b", "b"], [9, 9])).count() == 1


def test_forests_and_settled_links_by_plain_loops():
    """A forest connects what all candidates connect; settled links what all similar pairs connect, in one shard or two chunks."""
    r, rnd = np.random.default_rng(2), random.Random(2)
    f = r.integers(0, 2**64, (40, simhash.WIDE), dtype=np.uint64)
    f[:30] = f[0]
    f[:30, 0] ^= np.uint64(1) << np.arange(30, dtype=np.uint64)
    sets = [np.array(sorted(rnd.sample(range(13), 11)) if i < 30 else [100 + i], np.int64) for i in range(40)]
    size, label = np.array([len(x) for x in sets]), np.arange(40)

    def groups(a, b):
        low = list(range(40))
        for _ in range(40):
            for x, y in zip(a, b):
                low[x] = low[y] = min(low[x], low[y])
        return low

    for first in (None, 17):
        parts = list(simhash.candidates(f, size, label, 10, 0.8, first))
        a, b = (np.concatenate(x) for x in zip(*parts))
        assert sorted(zip(a.tolist(), b.tolist())) == [(i, j) for i in range(30) for j in range(i + 1, 30) if first is None or i < first <= j]
        chosen, now = simhash.spanning(label, a, b)
        assert len(chosen) == 29 and len(set(now.tolist())) == 11
        near = [(i, j) for i, j in zip(a.tolist(), b.tolist()) if len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j])) - 1e-9]
        x, y = simhash.linked(sets, label, iter(parts), 0.8)
        assert set(zip(x.tolist(), y.tolist())) <= set(near) and 0 < len(near) < len(a)
        assert groups(x, y) == groups(*zip(*near)) and len(x) == 40 - len(set(groups(x, y)))


def test_near_copies_of_short_empty_and_null(make_docs):
    texts = ["a", "A", "", None, "b c", "b  c", "x"]
    kept = {r.doc_id for r in simhash.keep_one_similar(make_docs(texts)).collect()}
    assert kept == {0, 2, 4, 6}
    assert simhash.keep_one_similar(make_docs([])).count() == 0


def test_rows_without_an_id_meet_all_others(make_docs):
    """Of a group one row stays: one with an id, where there is one."""
    long = " ".join(f"w{i}" for i in range(60))
    kept = simhash.keep_one_similar(make_docs(["a", "a", long, long + " x", "b", "b", "c"], [None, None, None, 7, 3, None, None])).collect()
    assert sorted((r.doc_id or 0, r.text[:3]) for r in kept) == [(0, "a"), (0, "c"), (3, "b"), (7, "w0 ")]


def test_hot_shards_lose_no_link(spark, monkeypatch):
    """32 fingerprints, each linked with five others only and alike in all tables' places: one component."""
    monkeypatch.setattr(simhash, "SHARD", 2)
    places = {int(p) for t in simhash.tables_for(32, 0.8) for p in t}
    free = [i for i in range(256) if i not in places]
    step = simhash.radius_of(0.8) // 2 + 1
    assert len(free) >= 5 * step
    rows = []
    for k in range(32):
        bits = np.zeros(256, np.uint8)
        for j in range(5):
            bits[free[j * step : (j + 1) * step]] = k >> j & 1
        rows.append((k, *np.packbits(bits, bitorder="little").view("<i8").tolist()))
    classes = spark.createDataFrame(rows, "id long, " + simhash.PRINT_DDL)
    assert {(r.node, r.component) for r in components(simhash.similar_links(classes, 0.8).select("a", "b")).collect()} == {(k, 0) for k in range(32)}
