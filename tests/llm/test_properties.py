"""Properties of the parts that run inside tasks, on generated inputs."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from warpline.llm import anchors, bpe, fmindex, media, rans, repeats, substrings, suffixdedup

FEW = settings(max_examples=40, deadline=None)


@FEW
@given(st.lists(st.binary(max_size=120), min_size=1, max_size=6), st.integers(8, 24))
def test_runs_own_every_window_once(docs, window):
    raw = np.frombuffer(b"".join(docs), np.uint8)
    off = np.cumsum([0, *map(len, docs)])
    doc, first, last, anchor = anchors.records(raw, off, window, 4)
    got = sorted((d, j) for d, a, b in zip(doc.tolist(), first.tolist(), last.tolist()) for j in range(a, b + 1))
    assert got == [(d, j) for d, t in enumerate(docs) for j in range(len(t) - window + 1)]
    owner = {}
    for d, a, b, k in zip(doc.tolist(), first.tolist(), last.tolist(), anchor.tolist()):
        for j in range(a, b + 1):
            assert owner.setdefault(docs[d][j : j + window], k) == k  # equal windows, equal anchors


@FEW
@given(st.lists(st.text("ab", min_size=32, max_size=60).map(str.encode), min_size=1, max_size=8))
def test_byte_classes(contents):
    who, offset, same = suffixdedup.byte_classes(contents, 32)
    text = [contents[w][o : o + 32] for w, o in zip(who.tolist(), offset.tolist())]
    assert len(text) == sum(len(c) - 31 for c in contents)
    assert len(set(zip(same.tolist(), text))) == len(set(same.tolist())) == len(set(text))


@FEW
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=5, max_size=30), min_size=1, max_size=8))
def test_word_classes(contents):
    who, offset, same = substrings.word_classes(contents, 5)
    text = [tuple(contents[w][o : o + 5]) for w, o in zip(who.tolist(), offset.tolist())]
    assert len(text) == sum(len(c) - 4 for c in contents)
    assert len(set(zip(same.tolist(), text))) == len(set(same.tolist())) == len(set(text))


@FEW
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60))
def test_backward_search_counts(ids):
    a = np.array([*ids, 0])
    index = fmindex.FMIndex(a, 8)
    ends = np.arange(1, len(ids) + 1)
    length, low, high = index.statistics(a, ends, 6)
    for e, n in zip(ends.tolist(), length.tolist()):
        longest = max((k for k in range(min(6, e) + 1) if sum(ids[i : i + k] == ids[e - k : e] for i in range(len(ids) - k + 1)) > 1), default=0)
        assert n == longest


@FEW
@given(st.lists(st.integers(0, 300), max_size=400))
def test_ans_round_trip(ids):
    a = np.array(ids, np.uint16)
    coder = rans.Coder(rans.frequencies(np.bincount(a, minlength=301)))
    assert (coder.decode(*coder.encode(a)[:2], len(a)) == a).all()


@FEW
@given(st.binary(max_size=50), st.binary(max_size=50))
def test_crc_of_joined_strings(a, b):
    import zlib

    assert rans.crc32_join([zlib.crc32(a), zlib.crc32(b)], [len(a), len(b)]) == zlib.crc32(a + b)


@FEW
@given(st.text("a' srevltmd\n1!é", max_size=200))
def test_scan_equals_the_automaton(text):
    kinds = bpe.classes()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    state, want = bpe.FRESH, []
    for k in kinds.tolist():
        state = bpe._step(state, k)
        want.append(state)
    assert bpe.states(kinds, run=7).tolist() == want


@FEW
@given(st.integers(1, 12), st.integers(1, 12), st.booleans(), st.integers(0, 2**32 - 1))
def test_media_round_trip(h, w, colour, seed):
    a = np.random.default_rng(seed).integers(0, 256, (h, w, 3) if colour else (h, w)).astype(np.uint8)
    assert (media.decode(media.encode_bmp(a)) == a).all()
    assert np.isclose(media.resize(a, 8, 9).mean(), a.mean())


@FEW
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 9)), max_size=8))
def test_covered_stretches(pairs):
    spans = [{"s": s, "e": s + n} for s, n in pairs]
    want = {i for x in spans for i in range(x["s"], x["e"] + 5)}
    got = repeats.covered(spans, 5)
    assert {i for s, e in got for i in range(s, e)} == want
    assert all(a[1] < b[0] for a, b in zip(got, got[1:]))
