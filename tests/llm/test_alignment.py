"""The dangling-suffix transducer against offsets of both libraries."""

import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from warpline.llm import alignment, registry
from warpline.llm.common import materialise

SF = "/root/testdata/sf0.001"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    return tok, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(texts, libraries):
    """Rows by byte offsets: tokens of each side, cut where both sides end."""
    tok, sp = libraries
    byte, rows, links = alignment.alphabet(), {}, Counter()
    for doc, text in texts.items():
        whole = (" " + (text or "")).encode()
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        spell_a = [bytes(byte[c] for c in tok.id_to_token(i)) for i in a]
        spell_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(spell_a) != whole or b"".join(spell_b) != whole:
            a, b = [], []
        ends = []
        for ids, spell in ((a, spell_a), (b, spell_b)):
            at, own = 0, {}
            for k in range(len(ids)):
                at += len(spell[k])
                own[at] = k + 1
            ends.append(own)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for c in cuts:
            groups.append((a[i : ends[0][c]], b[j : ends[1][c]]))
            i, j = ends[0][c], ends[1][c]
        links.update((x[-1], y[-1]) for x, y in groups)
        rows[doc] = (len(a), len(b), groups)
    best = Counter()
    for (_, y), n in links.items():
        best[y] = max(best[y], n)
    out = {}
    for doc, (n_a, n_b, groups) in rows.items():
        own = [(x[-1], y[-1]) for x, y in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out[doc] = (n_a, n_b, len(own), len(own), sum(links[p] == best[p[1]] for p in own), sum(links[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if own else "")
    return out, rows


def of(rows):
    return {r.doc_id: tuple(r)[1:] for r in rows.collect()}


def test_op13(spark, libraries):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = registry.op13_token_alignment(spark, SF)
    assert rows.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert of(rows) == brute(texts, libraries)[0]


ODD = [
    None, "", " ", "\n", "a", "  two  spaces ", "tab\tand\r\nlines\n\n\n", "naïve café – “quotes”", "日本語のテキスト", "emoji 👩‍👩‍👧 🏳️‍🌈", "a▁b", "▁", "<s> </s> <unk> <|endoftext|> <0x0A>",
    "\x00\x01\x7f", "̀́ é", "﻿bom", "\U0010ffff", " \u0085᠎ x", "can't WON'T she'll 'tis'", "1234567890" * 7, "x" * 3000, " " * 500, "a b " * 400, " non breaking",
]


def test_odd_texts(spark, make_docs, libraries):
    texts = dict(enumerate(ODD + ODD[3:9]))
    stored = materialise(alignment.align(make_docs(list(texts.values())), A, B))
    want, rows = brute(texts, libraries)
    assert of(alignment.digest(stored)) == want
    assert sum(v[0] > 0 for v in want.values()) > 20 and want[10][0] == 0  # what stands for a space isn't one
    got = {}
    for r in alignment.groups(stored).orderBy("doc_id", "group").collect():
        got.setdefault(r.doc_id, []).append((r.a_ids, r.b_ids))
    assert got == {k: v[2] for k, v in rows.items() if v[2]}


def test_both_encoders_of_side_a_agree_on_all_code_points(libraries):
    """Own ranks and merges against the file's own library, every code point in four contexts."""
    tok, a = libraries[0], alignment.SideA(A)
    assert a.ranks is not None
    for lo in range(0, 0x30000, 0x400):
        chars = [chr(c) for c in range(lo, lo + 0x400) if not 0xD800 <= c < 0xE000]
        text = " " + "".join(f"a{c}b {c}1{c} {c}{c}." for c in chars)
        assert a.encode(text) == tok.encode(text, add_special_tokens=False).ids


def test_a_long_text_is_cut_without_effect(monkeypatch):
    x = alignment.aligner(A, B)
    text = " ".join(["It's a long, long way;", "naïve  words", "1 2 3", "e-mail\nnext"] * 200)
    whole = x.align(text)
    monkeypatch.setattr(alignment, "PART", 50)
    assert len(x.parts(text)) > 50 and x.align(text) == whole


def test_transducer_of_two_small_vocabularies():
    """Leads change, suffixes shorten and empty; different bytes are an error; states are kept."""
    a, b = [b"ab", b"c", b"d", b"abcd"], [b"a", b"bc", b"d", b"bcd", b"x"]
    t = alignment.Transducer(a, b)
    assert t.run([0, 1, 2], [0, 1, 2]) == ([2, 3], [2, 3])
    assert t.run([3, 0, 1], [0, 3, 0, 1]) == ([1, 3], [2, 4])
    n = len(t.states)
    assert t.run([3, 0, 1], [0, 3, 0, 1]) == ([1, 3], [2, 4]) and len(t.states) == n
    with pytest.raises(ValueError):
        t.run([0], [4])


def test_empty_table_and_ids(spark, make_docs):
    assert alignment.digest(materialise(alignment.align(make_docs([]), A, B))).count() == 0
    rows = alignment.digest(materialise(alignment.align(make_docs(["a b", "a b", None], ids=[None, 7, 7]), A, B))).collect()
    assert sorted((r.doc_id is None, r.n_groups, r.count_sum) for r in rows) == [(False, 0, 0), (False, 2, 4), (True, 2, 4)]
