import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from warpline.llm import hmm


def small_model(k=3, symbols=5, seed=0):
    r = np.random.default_rng(seed)
    move, emit, start = r.random((k, k)), r.random((symbols, k)), r.random(k)
    return hmm.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def brute(model, seq):
    """Likelihood, expected emissions, moves and starts by all state paths."""
    k = len(model.start)
    total, emit, moves, starts = 0.0, np.zeros(model.emit.shape), np.zeros((k, k)), np.zeros(k)
    for path in itertools.product(range(k), repeat=len(seq)):
        p = model.start[path[0]] * math.prod(model.emit[s, q] for s, q in zip(seq, path)) * math.prod(model.move[a, b] for a, b in zip(path, path[1:]))
        total += p
        starts[path[0]] += p
        for s, q in zip(seq, path):
            emit[s, q] += p
        for a, b in zip(path, path[1:]):
            moves[a, b] += p
    return total, emit / total, moves / total, starts / total


def test_recursions_against_all_paths():
    m, r = small_model(), np.random.default_rng(1)
    seqs = [r.integers(0, 5, n) for n in (1, 4, 6, 3, 6)]
    flat, sizes = np.concatenate(seqs), np.array([len(s) for s in seqs])
    want = [brute(m, s) for s in seqs]
    assert np.allclose(hmm.likelihoods(m, flat, sizes), [math.log10(w[0]) for w in want])
    for got, i in zip(hmm.expected(m, flat, sizes), (1, 2, 3)):
        assert np.allclose(got, sum(w[i] for w in want), rtol=1e-4)


@pytest.mark.parametrize("top", [4, 10_000])
def test_scores(spark, make_docs, monkeypatch, top):
    monkeypatch.setattr(hmm, "BLOCK", 3000)
    texts = ["", None, " \n", "The the THE cat", "x" * 5000, "a b " * 4000] + ["the cat sat on the mat and the dog", "le chat est sur le tapis et le chien"] * 60
    rows = {r.doc_id: r for r in hmm.score(make_docs(texts), top=top).collect()}
    tokens = {i: ["".join(c.lower() if c.isascii() else c for c in w) for w in (t or "").split()] + [""] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(texts)
    for i, t in tokens.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    assert rows[6].score == rows[8].score
    out = [r for i, r in rows.items() if held[i] and i > 5]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_model_beats_base_on_held_out_texts(spark):
    rows = hmm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_probabilities_sum_to_one(spark, make_docs):
    """Over known words and one unknown word, texts of one word and the end."""
    m = hmm.first_model([b"", b"a"], np.array([0.5, 0.3]), 0.2)
    total = sum(10 ** hmm.likelihoods(m, np.array([s, 0]), np.array([2]))[0] for s in range(3))
    first_end = 10 ** hmm.likelihoods(m, np.array([0]), np.array([1]))[0]
    assert 0 < total <= 1 and 0 < first_end < 1 and np.allclose(m.emit.sum(axis=0), 1)


def test_rare_words_teach_states(spark, make_docs):
    """Words beyond the most frequent ones have classes of their own: with top=1 the model still beats the base."""
    rnd = __import__("random").Random(3)
    sides = [[f"{a}{i}" for i in range(40)] for a in "xy"]
    texts = [" ".join(rnd.choice(sides[k % 2]) for _ in range(40)) for k in range(300)]
    rows = [r for r in hmm.score(make_docs(texts), top=1).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 5 * len(rows)


def test_empty_and_untrained(spark, make_docs):
    assert hmm.score(make_docs([])).count() == 0
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    for r in hmm.score(make_docs(["a b", "c", None], ids)).collect():
        assert r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0.0 and abs(r.score) < 1e-9


def plain(texts, held, top, rounds):
    """doc -> (n_tokens, n_known, train_tokens, base_score, score) by loops in doubles: counts, Baum-Welch, forward recursion."""
    k = hmm.STATES
    split = {d: [*(t or "").lower().encode().split(), b""] for d, t in texts.items()}
    count = Counter(w for d, ws in split.items() if d not in held for w in ws)
    n, v = sum(count.values()), len(count)
    log = lambda w: math.log10((count[w] + 1) / (n + v + 1))
    words = sorted(count, key=lambda w: (-count[w], w))[:top]
    number = {w: i for i, w in enumerate(words)}
    signed = lambda h: h - (2**64 if h >= 2**63 else 0)
    kind = lambda w: signed(xxhash.xxh64_intdigest(w, 42)) % hmm.RARE
    rest = [1.0] * hmm.RARE
    for w, c in count.items():
        if w not in number:
            rest[kind(w)] += c + 1
    rest = [x / (n + v + 1) for x in rest]
    base = [(count[w] + 1) / (n + v + 1) for w in words]
    mass = np.array(base + rest)
    symbol = lambda w: number.get(w, len(words) + kind(w))
    emit = np.empty((len(mass), k))
    for i in range(len(mass)):
        lean = xxhash.xxh3_64_intdigest(words[i][:2]) % k if i < len(words) else (i - len(words)) % k
        emit[i] = [mass[i] * (3.0 if j == lean else 1.0) for j in range(k)]
    emit /= emit.sum(axis=0)
    move = np.array([[hmm.STAY if a == b else (1 - hmm.STAY) / (k - 1) for b in range(k)] for a in range(k)])
    start = np.full(k, 1 / k)
    for _ in range(rounds):
        e, m, s = hmm.PRIOR * mass[:, None] * np.ones(k), np.ones((k, k)), np.ones(k)
        for d, ws in split.items():
            if d in held:
                continue
            x = [symbol(w) for w in ws]
            alpha, scale = [], []
            for t, o in enumerate(x):
                a = (alpha[-1] @ move if t else start) * emit[o]
                scale.append(a.sum())
                alpha.append(a / a.sum())
            beta = np.ones(k)
            for t in range(len(x) - 1, -1, -1):
                if t + 1 < len(x):
                    ahead = emit[x[t + 1]] * beta / scale[t + 1]
                    m += np.outer(alpha[t], ahead) * move
                    beta = move @ ahead
                e[x[t]] += alpha[t] * beta
            s += alpha[0] * beta
        emit, move, start = e / e.sum(axis=0), m / m.sum(axis=1, keepdims=True), s / s.sum()
    out = {}
    for d, ws in split.items():
        a, score = start, 0.0
        for t, w in enumerate(ws):
            a = (a @ move if t else start) * emit[symbol(w)]
            score += math.log10(a.sum()) + (0.0 if w in number else log(w) - math.log10(rest[kind(w)]))
            a = a / a.sum()
        out[d] = (len(ws), sum(count[w] > 0 for w in ws), n, sum(map(log, ws)), score)
    return out


@pytest.mark.parametrize("top", [30, 10_000])
def test_scores_against_plain_baum_welch(spark, make_docs, monkeypatch, top):
    """The query's own columns, value by value: frequent and rare words, unknown ones, empty and repeated texts."""
    monkeypatch.setattr(hmm, "RARE", 16)
    r = np.random.default_rng(3)
    words = [f"{a}{b}" for a in "abcdefgh" for b in range(12)]
    texts = [" ".join(r.choice(words[(i % 4) * 20 : (i % 4) * 20 + 30], r.integers(1, 60))) for i in range(60)] + [None, "", "Never seen", "a1 B2 a1", "a1 B2 a1"]
    held = {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 == 2}
    want = plain(dict(enumerate(texts)), held, top, 4)
    rows = hmm.score(make_docs(texts), top=top).collect()
    assert len(rows) == len(texts) and {x.doc_id for x in rows if x.held_out} == held
    for x in rows:
        assert (x.n_tokens, x.n_known, x.train_tokens) == want[x.doc_id][:3]
        assert np.allclose((x.base_score, x.score), want[x.doc_id][3:], rtol=2e-4)
