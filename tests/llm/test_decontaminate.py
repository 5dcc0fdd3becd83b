import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from warpline.llm import decontaminate as D


def brute(texts, items, least=D.LEAST, share=D.SHARE):
    """All diagonals, without seeds."""
    import math

    out = set()
    for i, t in enumerate(texts):
        a = D.words_of((t or "").encode())
        for j, u in enumerate(items):
            b = D.words_of((u or "").encode())
            need = min(least, len(b))
            if not b:
                continue
            for d in range(-len(b) + 1, len(a)):
                same = [a[k] == b[k - d] for k in range(max(0, d), min(len(a), d + len(b)))]
                if any(sum(same[s : s + need]) >= math.ceil(share * need - 1e-9) for s in range(len(same) - need + 1)):
                    out.add((i, j))
    return out


def make(seed):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 6))) for _ in range(300)]
    prose = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [" ".join(prose(n)) for n in (14, 20, 37, 59, 5, 1)] + ["", None]
    texts = ["", None, "one", " ".join(prose(3000))]
    for item in items[:5]:
        w = item.split()
        texts.append(" ".join(prose(30) + w + prose(20)))
        texts.append(item.upper().replace(" ", ", ") + "!")
        if len(w) > 13:
            texts.append(" ".join(prose(5) + w[:13] + prose(9)))
            edited = list(w)
            edited[len(w) // 2] = "other"
            texts.append(" ".join(prose(700) + edited + prose(9)))
        texts.append(" ".join(prose(4) + w[: max(1, len(w) // 3)] + prose(4)))
    return texts, items


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, make_docs, seed):
    texts, items = make(seed)
    bench = spark.createDataFrame([(t, i, "x") for i, t in enumerate(items)], "text string, item_id long, words string")
    got = {(r.doc_id, r.item_id) for r in D.matches(make_docs(texts), bench).collect()}
    assert got == brute(texts, items)
    left = {r.doc_id for r in D.clean(make_docs(texts), bench).collect()}
    assert left == set(range(len(texts))) - {d for d, _ in got}


def test_empty_sides_and_repeated_rows(spark, make_docs):
    texts, items = make(3)
    bench = spark.createDataFrame([(t, i) for i, t in enumerate(items)], "text string, item_id long")
    assert D.matches(make_docs([]), bench).count() == 0
    assert D.matches(make_docs(texts), bench.limit(0)).count() == 0
    twice = make_docs([items[0], items[0], items[0]], [3, 3, None])
    assert sorted((r.doc_id or -1, r.item_id) for r in D.matches(twice, bench).collect()) == [(-1, 0), (3, 0)]
    assert D.clean(twice, bench).count() == 0


def test_long_items_are_measured_whole(spark, make_docs):
    """An item of 1,200 words, whole, with every tenth word replaced, and its last 40 words only."""
    w = [f"w{i}" for i in range(1200)]
    some = ["other" if i % 10 == 5 else x for i, x in enumerate(w)]
    texts = [" ".join(["a", "b", *w, "c"]), " ".join(["z"] * 900 + some), " ".join(w[-40:])]
    bench = spark.createDataFrame([(" ".join(w), 7), (" ".join(w), 8), (" ".join(w), None)], "text string, item_id long")
    got = {(r.doc_id, r.item_id): (r.first_word, r.n_words, r.n_equal) for r in D.matches(make_docs(texts), bench).collect()}
    want = [(2, 1200, 1200), (900, 1200, 1080), (0, 40, 40)]
    assert got == {(i, j): want[i] for i in range(3) for j in (7, 8, None)}
    seed = D.item_seeds(D.item_texts(bench).limit(1))
    assert seed.count() == len(D.MASKS) * (1200 - D.SPAN + 1) and "item_words" not in seed.columns


def test_rows_of_one_id_are_judged_apart(spark, make_docs):
    item = " ".join(f"q{i}" for i in range(20))
    docs = make_docs([item, "a clean text", "another", item], [None, None, 5, 5])
    bench = spark.createDataFrame([(item, 1)], "text string, item_id long")
    assert sorted(r.text for r in D.clean(docs, bench).collect()) == ["a clean text", "another"]


def test_every_allowed_replacement_is_found(spark, make_docs):
    """All placements of the words that may differ, in items of 3 to 13 words; one word more is not found."""
    texts, items, want = [], [], set()
    for n in (3, 5, 9, 10, 11, 12, 13):
        w = [f"w{n}x{i}" for i in range(n)]
        differ = n - math.ceil(0.8 * n - 1e-9)
        for k in range(differ + 2):
            for bad in itertools.combinations(range(n), k):
                if k <= differ:
                    want.add((len(texts), len(items)))
                texts.append(" ".join(["before", *("other" if i in bad else x for i, x in enumerate(w)), "after"]))
        items.append(" ".join(w))
    bench = spark.createDataFrame([(t, i) for i, t in enumerate(items)], "text string, item_id long")
    assert {(r.doc_id, r.item_id) for r in D.matches(make_docs(texts), bench).collect()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_common_seeds_against_brute_force(spark, make_docs, seed, monkeypatch):
    """Every seed counts as common; items of all lengths, edited passages, and a frame that all items share."""
    monkeypatch.setattr(D, "COMMON", 0)
    texts, items = make(seed)
    rnd = random.Random(seed)
    for _ in range(6):
        frame = [f"frame{i}" if keep == "1" else rnd.choice("pqrstuv") * 3 for i, keep in enumerate(D.MASKS[0])]
        items.append(" ".join(frame + [rnd.choice("abcdefgh") * 2 for _ in range(rnd.randint(0, 9))]))
        texts.append(" ".join(["before", *frame, *[rnd.choice("abcdefgh") * 2 for _ in range(9)]]))
    w = items[2].split()
    for gone in ((0, 12), (3, 4), (11,), (5, 6, 7)):
        texts.append(" ".join("z" if i in gone else x for i, x in enumerate(w[:13])))
    bench = spark.createDataFrame([(t, i) for i, t in enumerate(items)], "text string, item_id long")
    got = {(r.doc_id, r.item_id) for r in D.matches(make_docs(texts), bench).collect()}
    assert got == brute(texts, items)
    left = {r.doc_id for r in D.clean(make_docs(texts), bench).collect()}
    assert left == set(range(len(texts))) - {d for d, _ in got}


def test_a_seed_in_10000_items_and_10000_texts(spark, monkeypatch):
    """A frame of seven words that all have: no pair of text and item but the true ones."""
    frame = lambda tag: F.concat(*[F.lit(f"frame{i} ") if keep == "1" else F.concat(F.lit(f"{tag}{i}x"), "id", F.lit(" ")) for i, keep in enumerate(D.MASKS[0])])
    more = lambda tag: F.concat(*[F.concat(F.lit(f"{tag}m{i}x"), "id", F.lit(" ")) for i in range(6)])
    bench = spark.range(10_000).select(F.col("id").alias("item_id"), F.concat(frame("i"), more("i")).alias("text"))
    docs = spark.range(10_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 1000 == 0, F.concat(F.lit("so "), frame("i"), more("i"))).otherwise(F.concat(frame("d"), more("d"))).alias("text"))
    pairs, real = [], D._overlaps
    monkeypatch.setattr(D, "_overlaps", lambda s, p, *a: pairs.append(p.count()) or real(s, p, *a))
    got = D.matches(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1000 * i, 1000 * i) for i in range(10)]
    assert D.clean(docs, bench).count() == 9_990
    assert max(pairs) < 100
