import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from warpline.llm import language

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    test = [r for r in rows if r.held_out and r.lang and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in test) / len(test) > 0.97


def test_defined_cases(spark, make_docs):
    texts = ["the cat and the dog", "le chat et le chien", None, "", "123 ...", "the cat and the dog", "été", "la " * 30_000, "日本語", "𝒳"] + ["the cow and the hen", "le veau et la poule"] * 10
    docs = make_docs(texts, langs=["en", "fr", None, "en", "fr", None, None, None, None, None] + ["en", "fr"] * 10)
    rows = {r.doc_id: r for r in language.identify(docs).collect()}
    assert [rows[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and rows[2].score == 0
    assert rows[0][2:] == rows[5][2:] and rows[5].lang_pred == "en" and rows[7].lang_pred == "fr"
    assert rows[8].lang_pred in ("en", "fr") and rows[9].lang_pred in ("en", "fr")
    kept = language.accept(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {2, 3, 4}
    assert language.identify(make_docs([])).count() == 0
    assert language.identify(make_docs(["a b"], langs=[None])).first().lang_pred == "und"


def test_scores_are_kernel_products():
    rows = [("en", "the cat and the dog sat there"), ("fr", "le chat et le chien sont la"), ("en", "this is that and those"), ("fr", "ceci est cela et ceux")]
    m = language.train(rows)
    assert [m.languages[i] for i in m.scores([t for _, t in rows]).argmax(axis=1)] == [a for a, _ in rows]


def test_kernel_counts_all_grams():
    """Against sets of byte grams: shared grams, and sizes that count unknown ones too."""
    texts = [" the cat ", " le chat noir ", " zzz qqq "]
    raw = [language.normal(t) for t in texts]
    sets = [{t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in raw]
    codes, segment, owner, _ = language.segments(raw[:1])
    seen = np.unique(np.concatenate(language.grams(codes)))
    column = np.full(language.SPACE, len(seen), np.int32)
    column[seen] = np.arange(len(seen))
    codes, segment, owner, _ = language.segments(raw)
    m, size = language.presence(codes, segment, column, 3, len(seen))
    assert size.tolist() == [len(s) for s in sets]
    assert m.sum(axis=1).tolist() == [len(s & sets[0]) for s in sets]


def test_texts_with_letters_stay_without_labels(make_docs):
    docs = make_docs(["a clean text", "12 34", None, "", "été"], langs=[None] * 5)
    got = language.accept(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [0, 4]


def test_foreign_texts_are_rejected_and_null_languages_filled(spark):
    """With columns named as the operator's results; short texts stay, whatever their score."""
    en, fr = "the cat and the dog sat on the mat and then they went to the house ", "le chat et le chien sont sur le tapis et puis ils vont dans la maison "
    rows = [(i, (en, fr)[i % 2] * (1 + i % 3) + str(i), ("en", "fr")[i % 2]) for i in range(60)]
    rows += [(100, en, None), (101, fr, None), (102, "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0" * 30, None), (103, "\u65e5\u672c", None), (104, "zxq vjk " * 30, "en")]
    docs = spark.createDataFrame([(*r, 0.5, "p", "q") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string, __lang string")
    got = {r.doc_id: r for r in language.accept(docs).collect()}
    assert set(range(60)) | {100, 101, 103} <= set(got) and 102 not in got
    assert got[100].lang == "en" and got[101].lang == "fr" and got[0].lang == "en" and got[100].score == 0.5
    assert language.accept(docs, least=0.0).count() == len(rows)


def test_all_languages_are_learned_and_copies_count_once(make_docs):
    """Languages beyond a few hundred; a third of the rows one text."""
    langs = [f"l{i:03d}" for i in range(300)]
    texts = [f"{chr(97 + i % 26)}{chr(97 + i // 26)} word{chr(97 + i % 26)} text" for i in range(300)]
    docs = make_docs(texts + [texts[0]] * 150, ids=list(range(1, 301)) + [7] * 150, langs=langs + [langs[0]] * 150)
    rows = language.sample(docs, ~language.held_out()).collect()
    assert {r.lang for r in rows} == {a for i, a in enumerate(langs, 1) if zlib.crc32(str(i).encode()) % 5} and len(rows) <= 301


def test_segments_are_spread_over_the_whole_text():
    text = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)) * 10
    parts = language.spread(text)
    assert len(parts) == language.SEGMENTS and parts[-1] in language.normal(text)[-language.SEGMENT :]


def test_op7_against_plain_loops(spark):
    """Sets of grams, the Nystrom kernel, the ridge regressions and the averages over segments, value by value, on a whole table."""
    from warpline.llm import registry

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.lang, [bytes(p) for p in r.segments]) for r in language.sample(docs, ~language.held_out()).collect()]
    train = {(r.lang, r.text) for r in docs.collect() if r.lang and language.has_letter(r.text) and zlib.crc32(str(r.doc_id).encode()) % 5}
    assert sorted((a, tuple(language.spread(t))) for a, t in train) == sorted({(a, tuple(p)) for a, p in rows})
    gram_set = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    pieces = sorted((a, p) for a, ps in rows for p in ps)
    langs = sorted({a for a, _ in pieces})
    rng = np.random.default_rng(7)
    marks = [int(i) for a in langs for i in rng.permutation([j for j, (b, _) in enumerate(pieces) if b == a])[: max(1, language.LANDMARKS // len(langs))]]
    sets = [gram_set(p) for _, p in pieces]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    k = np.array([[kernel(s, sets[m]) for m in marks] for s in sets])
    count = {a: sum(b == a for b, _ in pieces) for a in langs}
    w = np.array([1 / count[a] for a, _ in pieces])
    y = np.array([[float(a == b) for b in langs] for a, _ in pieces])
    left = (k * w[:, None]).T @ k + language.RIDGE * k[marks] + 1e-8 * np.eye(len(marks))
    alpha = np.linalg.solve(left, (k * w[:, None]).T @ y)
    got = {r.doc_id: r for r in registry.op7_language(spark, sf).collect()}
    checked = 0
    for r in docs.collect():
        g = got.pop(r.doc_id)
        if not language.has_letter(r.text):
            assert (g.lang_pred, g.score) == ("und", 0.0)
            continue
        clean = language.normal(r.text)
        parts = [clean[i : i + language.SEGMENT] for i in range(0, len(clean), language.SEGMENT)]
        value = sum(len(p) * (np.array([kernel(gram_set(p), sets[m]) for m in marks]) @ alpha) for p in parts) / len(clean)
        p = np.exp(language.SHARPNESS * (value - value.max()))
        p /= p.sum()
        assert g.lang_pred == langs[int(p.argmax())] and abs(g.score - p.max()) < 2e-3
        checked += 1
    assert not got and checked > 150


EN, FR = "the cat and the dog sat on the mat and then they went to the house ", "le chat et le chien sont sur le tapis et puis ils vont dans la maison "


def test_rows_beyond_the_landmarks_are_learned(spark, monkeypatch):
    """A row that no landmark is drawn from changes the model; repeated rows and other partitions don't change a bit."""
    monkeypatch.setattr(language, "PER_LANGUAGE", 4)
    rows = [(i, (EN, FR)[i % 2] * (1 + i % 5) + chr(97 + i % 26) * (i % 7), ("en", "fr")[i % 2]) for i in range(40)]
    make = lambda rows, n=3: spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(n)
    drawn = lambda docs: sorted((r.lang, tuple(map(bytes, r.segments))) for r in language.sample(docs, ~language.held_out()).collect())
    chosen = {p for _, p in drawn(make(rows))}
    other = next(r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 and tuple(language.spread(r[1])) not in chosen)
    less = [r for r in rows if r != other]
    assert drawn(make(less)) == drawn(make(rows))
    whole = language.fit(make(rows), ~language.held_out())
    assert not np.array_equal(whole.weights, language.fit(make(less), ~language.held_out()).weights)
    assert np.array_equal(whole.weights, language.fit(make(rows * 2, 5), ~language.held_out()).weights)


def test_pipeline_learns_whole_texts(spark):
    """The third of six segments, which isn't among the four that are spread over a text."""
    long = [language.normal(EN * 100)[:5900].decode(), language.normal(FR * 100)[:5900].decode()]
    rows = [(i, long[i % 2], ("en", "fr")[i % 2]) for i in range(6)]
    cut = lambda t: t[:2100] + "wxyzqvjk" * 100 + t[2900:]
    model = lambda rows, n: language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), per_text=n).weights
    changed = [(i, cut(t), a) if i == 0 else (i, t, a) for i, t, a in rows]
    assert np.array_equal(model(rows, language.SEGMENTS), model(changed, language.SEGMENTS))
    assert not np.array_equal(model(rows, None), model(changed, None))


def test_threshold_is_set_by_all_held_out_texts(spark, monkeypatch):
    monkeypatch.setattr(language, "PER_LANGUAGE", 2)
    rows = [(i, (EN, FR)[i % 2] * (1 + i % 3) + chr(97 + i % 26) * (i % 50), ("en", "fr")[i % 2]) for i in range(150)]
    docs = spark.createDataFrame([*rows, (500, "12 " * 30, "en"), (501, "zq", "en"), (502, EN[9:] + FR, None)], "doc_id long, text string, lang string")
    model = language.fit(docs, ~language.held_out())
    held = [t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 20
    lowest = language.chances(model.scores(held)).max(axis=1).min()
    assert abs(language.threshold(docs, model, language.held_out()) - (0.5 + (lowest - 0.5) / 4)) < 1e-6
