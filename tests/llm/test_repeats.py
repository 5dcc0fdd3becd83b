import hashlib
import random
import tempfile
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest

from warpline.llm import fmindex, induced, substrings, suffixdedup


def corpus(seed, n=60):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghiéñ") for _ in range(rnd.randint(1, 9))) for _ in range(400)]
    prose = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    passage = [prose(60) for _ in range(4)]
    texts = ["", None, "x", "ab " * 300, "Ü, " * 400, "a" * 700, prose(40), " \n\t"]
    while len(texts) < n:
        kind = rnd.random()
        if kind < 0.4:
            texts.append(prose(rnd.randint(1, 150)))
        elif kind < 0.8:
            texts.append(" ".join([prose(rnd.randint(0, 40)), rnd.choice(passage), prose(rnd.randint(0, 40)), rnd.choice(passage)]))
        else:
            words = (rnd.choice([t for t in texts if t]) or "x").split(" ")
            if rnd.random() < 0.7:
                words[rnd.randrange(len(words))] = "edit"
            texts.append(" ".join(words))
    return texts


def brute_bytes(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for r in raw:
        for i in range(len(r) - window + 1):
            seen[r[i : i + window]] += 1
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows, window):
    first = {}
    split = {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(split):
        for s in range(len(split[i]) - window + 1):
            first.setdefault(tuple(split[i][s : s + window]), (i, s))
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (i, s):
                gone[s : s + window] = [True] * window
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize(("hot", "shard"), [(None, None), (2, 3000)])
def test_bytes_against_brute_force(make_docs, hot, shard):
    texts = corpus(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.deduplicate(make_docs(texts), hot=hot, shard=shard).collect()}
    assert got == dict(enumerate(brute_bytes(texts, 200)))


@pytest.mark.parametrize(("hot", "shard"), [(None, None), (2, 3000)])
def test_words_against_brute_force(make_docs, hot, shard):
    texts = corpus(6)
    ids = list(range(len(texts)))
    random.Random(2).shuffle(ids)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.deduplicate(make_docs(texts, ids), hot=hot, shard=shard).collect()}
    assert got == brute_words(list(zip(ids, texts)), 20)


def test_long_texts_are_cut_in_pieces(make_docs, monkeypatch):
    from warpline.llm import anchors

    texts = corpus(7, 40)
    texts.append(" ".join(t or "" for t in texts[:25]))
    off = np.cumsum([0, *(len((t or "").encode()) for t in texts)])
    raw = np.frombuffer("".join(t or "" for t in texts).encode(), np.uint8)
    monkeypatch.setattr(anchors, "PIECE", 700)
    doc, first, last, _ = anchors.records(raw, off, 200, 32)
    seen = sorted((d, j) for d, a, b in zip(doc.tolist(), first.tolist(), last.tolist()) for j in range(a, b + 1))
    assert seen == [(d, j) for d in range(len(texts)) for j in range(max(0, off[d + 1] - off[d] - 199))]


def test_repeated_rows_empty_table_and_null_ids(spark, make_docs):
    long = "word%d " * 60 % tuple(range(60))
    d = make_docs([long, long, "a b"], ids=[None, None, None])
    assert sorted(r.n_removed for r in suffixdedup.deduplicate(d).collect()) == [0, len(long), len(long)]
    assert [r.n_removed for r in substrings.deduplicate(d).collect()] == [0, 0, 0]
    for f in (suffixdedup.deduplicate, substrings.deduplicate):
        assert f(make_docs([])).count() == 0


def test_clean_keeps_rows_and_columns(make_docs):
    texts = corpus(8, 40)
    docs = make_docs(texts)
    got = suffixdedup.clean(docs)
    assert got.columns == docs.columns
    rows = {r.doc_id: r for r in got.collect()}
    for i, (n, removed, _, digest) in enumerate(brute_bytes(texts, 200)):
        if not removed:
            assert rows[i].text == texts[i]
        else:
            assert len(rows[i].text.encode()) <= n - removed and rows[i].n_chars == len(rows[i].text)


@pytest.mark.parametrize("base", [1, 6, 10_000])
@pytest.mark.parametrize("memory", [64, 1 << 20])
def test_suffix_array_against_brute_force(monkeypatch, base, memory):
    monkeypatch.setattr(induced, "MEMORY", memory)
    r = np.random.default_rng(base)
    for _ in range(150):
        n, cap = int(r.integers(1, 80)), int(r.integers(1, 30))
        t = np.repeat(r.integers(0, r.integers(1, 6), n), r.integers(1, 4))
        t[len(t) // 2 :] = t[: len(t) - len(t) // 2]
        places, prefix = induced.suffix_array(t.astype(np.int16), cap, base)
        s = [tuple(t[i : i + cap].tolist()) for i in range(len(t))]
        assert sorted(places.tolist()) == list(range(len(t)))
        order = [s[i] for i in places.tolist()]
        assert order == sorted(s)
        for (x, y), k in zip(zip(order, order[1:]), prefix.tolist()[1:]):
            assert x[:k] == y[:k] and (k == cap or k == min(len(x), len(y)) or x[k] != y[k])


def test_shards_run_recursion_and_disk_runs_with_normal_settings():
    """A shard of text of 1 MB: several levels, runs and arrays on disk; windows are classed as by hashing."""
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(1, 9))) for _ in range(3000)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(400)).encode()
    contents = []
    while sum(map(len, contents)) < 1 << 20:
        at = rnd.randrange(len(passage) - 300)
        contents.append(" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(20, 400))).encode() + passage[at : at + rnd.randint(0, 300)])
    before = dict(induced.RAN)
    who, offset, same = suffixdedup.byte_classes(contents, 200)
    ran = {k: v - before[k] for k, v in induced.RAN.items()}
    assert ran["levels"] >= 4 and ran["spills"] >= 1 and ran["filed"] >= 3
    assert len(who) == sum(max(0, len(c) - 199) for c in contents)
    number = {}
    want = [number.setdefault(hash(contents[w][o : o + 200]), len(number)) for w, o in zip(who.tolist(), offset.tolist())]
    pairs = set(zip(same.tolist(), want))
    assert len(pairs) == len(set(same.tolist())) == len(number) < len(who)


def test_queue_order_with_ties_and_runs(monkeypatch):
    """Long runs of one symbol, all symbols alike, and many symbols, with tiny ranges."""
    monkeypatch.setattr(induced, "RANGE", 2)
    monkeypatch.setattr(induced, "MEMORY", 16)
    r = np.random.default_rng(5)
    for t in ([3] * 90, [0] * 40 + [1] * 40, [5, 4, 3, 2, 1, 0] * 15, r.permutation(200).tolist(), r.integers(0, 40_000, 300).tolist(), [1, 2] * 60, [7]):
        places, prefix = induced.suffix_array(np.array(t), 40, 1)
        s = [tuple(t[i : i + 40]) for i in range(len(t))]
        order = [s[i] for i in places.tolist()]
        assert sorted(places.tolist()) == list(range(len(t))) and order == sorted(s)
        for (x, y), k in zip(zip(order, order[1:]), prefix.tolist()[1:]):
            assert x[:k] == y[:k] and (k == 40 or k == min(len(x), len(y)) or x[k] != y[k])


@pytest.mark.parametrize("chunk", [1, 4, 7])
def test_small_blocks_and_whole_files_against_brute_force(monkeypatch, chunk):
    """Every array on disk, blocks of a few rows, external sorts with many runs, symbols that are taken block by block."""
    for name, value in (("MEMORY", 4 * chunk), ("CHUNK", chunk), ("RANGE", chunk), ("WIDEST", chunk + 1)):
        monkeypatch.setattr(induced, name, value)
    r, before = np.random.default_rng(chunk), dict(induced.RAN)
    for trial in range(60):
        n, cap = int(r.integers(0, 60)), int(r.choice([1, 2, 3, 10, 40, 200]))
        t = r.integers(0, int(r.integers(1, 6)), n).tolist()
        t = [0] * n if trial % 7 == 0 else (t[:7] * 12)[:60] if trial % 5 == 0 else t
        n = len(t)
        places, prefix = induced.suffix_array(np.array(t, np.int64), cap, int(r.choice([1, 2, 8, 1024])))
        order = [tuple(t[i : i + cap]) for i in places.tolist()]
        assert sorted(places.tolist()) == list(range(n)) and order == sorted(order)
        want = [0] * min(n, 1) + [next((k for k, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y))) for x, y in zip(order, order[1:])]
        assert prefix.tolist() == want
    assert all(induced.RAN[k] > before[k] for k in ("levels", "spills", "filed", "merges", "blocks"))


def test_external_sort_against_a_sort(monkeypatch):
    monkeypatch.setattr(induced, "CHUNK", 50)
    r = np.random.default_rng(1)
    for n in (0, 1, 49, 50, 51, 3000):
        key, sorter = r.integers(0, max(1, n // 3), n).astype(np.uint64), induced.Sorter()
        for s in range(0, n, 17):
            sorter.add(key[s : s + 17], np.arange(s, min(n, s + 17)))
        got = list(sorter.merged())
        k, i = (np.concatenate([g[j] for g in got]) if got else np.empty(0) for j in (0, 1))
        assert k.tolist() == sorted(key.tolist()) and sorted(i.tolist()) == list(range(n)) and all(key[b] == a for a, b in zip(k.tolist(), i.tolist()))
        assert n < 3000 or max(len(g[0]) for g in got) < n / 2


def test_memory_is_bounded_at_32_million_symbols():
    """64 MB besides mapped scratch files, for text of random words, copied passages and long runs; against brute force on a sample."""
    n, cap = 32_000_000, 200
    r = np.random.default_rng(1)
    passages = r.integers(97, 123, 1 << 16).astype(np.int16)
    with tempfile.TemporaryFile() as f:
        for s in range(0, n, 1 << 18):
            w = r.integers(97, 123, min(1 << 18, n - s)).astype(np.int16)
            w[r.random(len(w)) < 0.3] = 32
            for _ in range(8):
                a, b = int(r.integers(0, 60_000)), int(r.integers(0, len(w) - 5000))
                w[b : b + 5000] = passages[a : a + 5000]
            if (s >> 18) % 4 == 0:
                w[1000:20_000] = 7
            w.tofile(f)
        f.flush()
        text = np.asarray(np.memmap(f, np.int16, "r", shape=(n,)))
    tracemalloc.start()
    try:
        places, prefix = induced.suffix_array(text, cap)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 64 << 20
    seen = np.zeros(n, bool)
    seen[places] = True
    assert len(places) == n and seen.all()
    for i in r.integers(1, n, 5000).tolist():
        a, b = (text[p : p + cap].tolist() for p in (int(places[i - 1]), int(places[i])))
        same = next((k for k, (u, v) in enumerate(zip(a, b)) if u != v), min(len(a), len(b)))
        assert prefix[i] == same and a[same:] <= b[same:]


def test_index_is_smaller_than_its_text():
    """Against the bytes of its words; and counts across many blocks are right."""
    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(2000)]
    words = [min(rnd.randrange(2000), rnd.randrange(2000)) for _ in range(50_000)]
    ids = np.array([w + 1 for w in words] + [0])
    index = fmindex.FMIndex(ids, 20)
    assert index.nbytes < sum(len(vocabulary[w]) + 1 for w in words) / 2
    assert not hasattr(index, "rows")
    length, low, high = index.statistics(ids, np.array([1000, 30_000, 50_000]), 1)
    assert (high - low).tolist() == [words.count(words[e - 1]) for e in (1000, 30_000, 50_000)]


def test_copies_of_one_row_bring_their_stretches_once(make_docs):
    """3,000 rows of one text under one id, and without any: the stretches of a row stand once, the result on every row."""
    text = "".join(chr(97 + i * i % 26) for i in range(400))
    texts, ids = [text] * 3000 + ["other " + text[:150]] + [text] * 50, [5] * 3000 + [6] + [None] * 50
    out = suffixdedup.deduplicate(make_docs(texts, ids)).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in out) == sorted([(0, 400)] * 50 + [(5, 400)] * 3000 + [(6, 0)])
    _, spans = suffixdedup._spans(make_docs(texts, ids), 200, "doc_id", "text", "all")
    assert max(len(r.spans) for r in spans.collect()) < 50
