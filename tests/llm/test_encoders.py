import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from warpline.llm import bpe, rans

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", None, "Don't we'll 12 3", "a\n\n  b \t c", "<|endoftext|>", "é́ ß 😀 İ", "a" * 3000, " " * 500, "x y " * 2000, "the cat sat", "the cat sat", "\x1f\x85 '"]


@pytest.fixture(scope="module")
def enc():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_boundaries_against_library(enc):
    rnd, v = random.Random(3), bpe.vocabulary(BYTE)
    for _ in range(3000):
        t = "".join(rnd.choice("a'  \n\tst're ll ve dm 1٣ é ß-!.　\xa0̀x😀") for _ in range(rnd.randint(0, 40)))
        assert v.encode(t)[0] == enc.encode_ordinary(t)


def test_groups_of_texts_against_library(enc, monkeypatch):
    """Texts side by side in one group: edges of texts are edges of slices, whatever stands there."""
    rnd, v = random.Random(5), bpe.Vocabulary(BYTE)
    monkeypatch.setattr(v, "GROUP", 200, raising=False)
    texts = ["".join(rnd.choice("a'  \n\tst're ll ve dm 1\u0663 \u00e9 -!.\u3000\xa0x\U0001f600") for _ in range(rnd.choice((0, 1, 2, 3, 9, 30)))) for _ in range(4000)]
    for t, (ids, starts, tokens) in zip(texts, v.encode_all(texts), strict=True):
        assert ids.tolist() == enc.encode_ordinary(t)
        raw, n = t.encode(), 0
        for s, e, k in zip(starts.tolist(), [*starts.tolist()[1:], len(raw)], tokens.tolist()):
            assert v.decode(ids[n : n + k].tolist()) == raw[s:e]
            n += k
        assert n == len(ids)


def test_both_ways_of_merging_agree():
    rnd, v = random.Random(6), bpe.vocabulary(BYTE)
    for _ in range(3000):
        piece = "".join(rnd.choice("etaoin \u00e9\u65e5") for _ in range(rnd.randint(2, 20))).encode()
        assert v.merge(piece) == (v.merge_long(piece) if piece not in v.ranks else [v.ranks[piece]])


def test_round_trip_query(spark, make_docs, enc):
    rows = {r.doc_id: r for r in bpe.round_trip(make_docs(TEXTS), BYTE).collect()}
    for i, t in enumerate(TEXTS):
        ids = enc.encode_ordinary(t or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(make_docs([]), BYTE).count() == 0


def test_encode_then_decode_tables(spark, make_docs):
    e = bpe.encode(make_docs(TEXTS), BYTE)
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(e, BYTE).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    r = e.filter("doc_id = 2").first()
    assert sum(r.slice_tokens) == r.n_tokens and r.slice_starts[:3] == [0, 3, 5]


def test_ans_blocks_and_checkpoints():
    step = rans.CHECK * rans.LANES
    ids = np.random.default_rng(0).zipf(1.3, 3 * step + 5000).clip(max=40_000).astype(np.uint16)
    coder = rans.Coder(rans.frequencies(np.bincount(ids, minlength=49408)))
    for n in (0, 1, rans.LANES, rans.LANES + 1, len(ids)):
        body, states, checks = coder.encode(ids[:n])
        assert (coder.decode(body, states, n) == ids[:n]).all()
        assert (coder.decode_block(body, states, checks, n) == ids[:n]).all()
    for k in range(1, 4):
        assert (coder.decode_part(body, checks, len(ids), k) == ids[k * step : (k + 1) * step]).all()


def test_words_equal_the_library():
    """Against an untouched tokenizer, added tokens in all places and cases."""
    tok, w, rnd = Tokenizer.from_file(WORD), rans.Words(WORD), random.Random(8)
    pieces = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|end", "|>", "it's", "WE'LL", "\u00e9", "e\u0301", "\u0301", "\u0130", "\u1e9e", "\ufb01", "\u00a0", "\u3000", "\u65e5\u672c", "\U0001f600", "\t", "\r\n", "\n", "12", "a,", "b.", ",", "Ab", "x-y", "\u01c4", "\x1f", "\u0660", "  "]
    texts = ["".join(rnd.choice(pieces) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 14))) for _ in range(20_000)]
    for s in range(0, len(texts), 1000):
        ids, sizes = w.encode(texts[s : s + 1000])
        assert np.split(ids, np.cumsum(sizes)[:-1])[0].tolist() == tok.encode(texts[s], add_special_tokens=False).ids
        want = [e.ids for e in tok.encode_batch(texts[s : s + 1000], add_special_tokens=False)]
        assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    plain = Tokenizer.from_file(WORD)
    plain.encode_special_tokens = True
    ids, sizes = rans.Words(WORD, special_as_text=True).encode(texts[:2000])
    assert ids.tolist() == [i for e in plain.encode_batch(texts[:2000], add_special_tokens=False) for i in e.ids]


def test_other_tokenizer_files_get_whole_texts():
    path = P.path("byte_bpe_50k.json")
    tok, w = Tokenizer.from_file(path), rans.Words(path)
    texts = ["", "a b  c", "x <|endoftext|> Y", "\n\n z"]
    ids, sizes = w.encode(texts)
    assert not w.by_words and ids.tolist() == [i for e in tok.encode_batch(texts, add_special_tokens=False) for i in e.ids]
    assert sizes[0] == 0


def test_token_files(spark, make_docs, monkeypatch):
    tok = Tokenizer.from_file(WORD)
    order = list(range(len(TEXTS)))
    random.Random(1).shuffle(order)
    docs = make_docs([TEXTS[i] for i in order], ids=[10 * i for i in order])
    blocks, freq = rans.write_ids(docs, WORD, end_id=1, vocabulary=49408)
    rows = {r.doc_id: r for r in rans.read_digest(blocks, freq).collect()}
    start = 0
    for i, t in enumerate(TEXTS):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        r = rows[10 * i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_empty_and_long(spark, make_docs):
    blocks, freq = rans.write_ids(make_docs([]), WORD, end_id=1, vocabulary=49408)
    assert rans.read_digest(blocks, freq).count() == 0
    long = "ab cd " * (rans.BLOCK // 2 + 1000)
    blocks, freq = rans.write_ids(make_docs([long, "x"]), WORD, end_id=1, vocabulary=49408)
    rows = {r.doc_id: r for r in rans.read_digest(blocks, freq).collect()}
    ids = rans.words(WORD).encode([long])[0].tolist() + [1]
    assert len(ids) > rans.BLOCK and rows[0].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert rows[1].start == len(ids)
