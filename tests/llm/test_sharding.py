"""Longest-processing-time shards against a plain loop."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from warpline.llm import lpt, registry

SF = "/root/testdata/sf0.001"


def loop(sizes, shards):
    """Loads of plain LPT: each size, the largest first, to the least load."""
    loads = [0] * shards
    for s in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += s
    return sorted(loads)


def check(rows, texts, shards):
    """One shard a text, true sizes and crcs, gapless slots; returns the loads of the shards."""
    assert len(rows) == len(texts)
    where, loads, slots = defaultdict(set), Counter(dict.fromkeys(range(shards), 0)), defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        where[raw].add(r.shard)
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(len(x) == 1 for x in where.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return sorted(loads.values())


def test_op11(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = registry.op11_lpt_shards(spark, SF)
    assert rows.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = check(rows.collect(), texts, 40)
    sizes = Counter()
    for t in texts.values():
        sizes[t or ""] += len((t or "").encode()) + 16
    assert got == loop(sizes.values(), 40)


@pytest.mark.parametrize("seed", range(3))
def test_schedule_equals_a_loop(seed):
    rnd = random.Random(seed)
    sizes = [rnd.randint(1, 50) for _ in range(200)]
    where, loads = lpt.schedule([(s, i.to_bytes(16, "big")) for i, s in enumerate(sizes)], 7)
    assert sorted(loads) == loop(sizes, 7) and len(where) == 200
    own = Counter()
    for i, s in enumerate(sizes):
        own[where[i.to_bytes(16, "big")]] += s
    assert [own[s] for s in range(7)] == loads


def test_bundles_keep_shards_near_equal(spark, make_docs):
    """Few, coarse bundles: small groups move together, large ones alone, groups are never cut."""
    rnd = random.Random(1)
    texts = ["x" * rnd.randint(0, 30) + str(rnd.randint(0, 400)) for _ in range(1500)] + ["large " * 500, "y" * 700] + ["copy " * 3] * 300
    loads = check(lpt.place(make_docs(texts), shards=5, grain=10).collect(), dict(enumerate(texts)), 5)
    total = sum(loads)
    hot = 300 * (15 + 16)
    assert max(loads) <= max(hot, total / 5 + total / 50 + 200)


def test_defined_cases(spark, make_docs):
    texts = [None, "", "a", "a", "a", None, "é" * 70_000]
    rows = lpt.place(make_docs(texts, ids=[0, 1, 2, 3, 4, 5, 6]), shards=3)
    check(rows.collect(), dict(enumerate(texts)), 3)
    assert lpt.place(make_docs([]), shards=3).count() == 0
    same = lpt.place(make_docs(["a", "a", None], ids=[None, None, None]), shards=2).collect()
    assert len(same) == 3 and sorted(r.slot for r in same) in ([0, 0, 1], [0, 1, 2])


def test_assign_and_write_keep_all_columns(spark, make_docs, tmp_path):
    docs = make_docs(["a", "b", "a", None]).withColumnRenamed("words", "group").withColumnRenamed("key", "a.b").withColumnRenamed("salt", "size")
    out = lpt.assign(docs, shards=2)
    assert out.columns == [*docs.columns, "shard"]
    assert sorted(map(str, out.drop("shard").collect())) == sorted(map(str, docs.collect()))
    with pytest.raises(ValueError):
        lpt.assign(out, shards=2)
    lpt.write(docs, str(tmp_path / "s"), shards=2)
    back = spark.read.parquet(str(tmp_path / "s"))
    key = lambda df: sorted((r.doc_id, r.shard) for r in df.collect())
    assert key(back) == key(out)
    where = dict(key(out))
    assert where[0] == where[2]
