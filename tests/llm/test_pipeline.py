import base64
import hashlib
import os
import shutil

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_repeats import brute_bytes
from tests.llm.test_simhash import near_groups
from warpline.llm import language


def cut_text(text, others):
    """The text without bytes in strings of 200 bytes that also start elsewhere."""
    raw = text.encode()
    gone = [False] * len(raw)
    for i in range(len(raw) - 199):
        if others[raw[i : i + 200]] > 1:
            gone[i : i + 200] = [True] * 200
    parts, last = [bytearray()], False
    for b, g in zip(raw, gone):
        if g and not last:
            parts.append(bytearray())
        if not g:
            parts[-1].append(b)
        last = g
    return "".join(p.decode(errors="ignore") for p in parts)  # of each kept stretch whole characters only


def test_pipeline_against_brute_force(spark, tmp_path):
    """The whole run on a small table equals the stages done by brute force."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    base = os.fspath(tmp_path)
    extra = [(900, None, "en", "s", 0), (901, "12 34", "en", "s", 5), (902, docs[0].text, "fr", "s", 1)]
    spark.createDataFrame([*map(tuple, docs), *extra], spark.read.parquet(f"{sf}/documents.parquet").schema).coalesce(2).write.parquet(f"{base}/documents.parquet")
    shutil.copy(f"{sf}/benchmark.parquet", f"{base}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, base).collect()}

    rows = {r[0]: r[1] for r in [*map(tuple, docs), *extra] if language.has_letter(r[1])}
    ids = sorted(rows)
    low = near_groups([rows[i] for i in ids], ids)
    rows = {i: rows[i] for i in ids if low[i] == i}
    seen = {}
    for t in rows.values():
        raw = t.encode()
        for i in range(len(raw) - 199):
            seen[raw[i : i + 200]] = seen.get(raw[i : i + 200], 0) + 1
    rows = {i: cut_text(t, seen) for i, t in rows.items()}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    keys = sorted(rows)
    bad = {keys[i] for i, _ in leaks([rows[k] for k in keys], items)}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: enc.encode_ordinary(t) for i, t in rows.items() if i not in bad}
    assert {i: r.ids for i, r in got.items()} == want


def test_stages_keep_the_columns(spark, make_docs):
    docs = make_docs(["a b c", None, ""]).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:4]:
        for d in (docs, docs.limit(0)):
            assert stage(spark, d, "/root/testdata/sf0.001").columns == docs.columns


def test_stages_keep_clashing_names_and_their_values(spark, make_docs):
    """Columns under the operators' own names come through all filtering stages as they were."""
    passage = "".join(chr(97 + i * 7 % 26) + (" " if i % 5 == 0 else "") for i in range(300))
    docs = make_docs([" ".join(f"{w}{i}" for i in range(150)) + passage for w in "xy"] + [None, "short"]).select("doc_id", "text", "lang", "source", "n_chars")
    names = ("__th", "__kept", "__nid", "__id", "__key", "a.b", "th", "nid", "group", "shard", "spans", "___________kept")
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.concat(F.lit(f"keep {i} "), "doc_id"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
        got = {r.doc_id: r for r in out.collect()}
        assert set(got) == ({0, 1, 3} if name == "language_id" else {0, 1, 2, 3})
        assert all(r[c] == f"keep {i} {k}" for k, r in got.items() for i, c in enumerate(names))
        assert name != "suffix_dedup" or all(passage not in r.text for r in got.values() if r.text)


def test_pipeline_on_an_empty_table_and_without_ids(spark, make_docs, tmp_path):
    shutil.copy("/root/testdata/sf0.001/benchmark.parquet", tmp_path / "benchmark.parquet")
    docs = make_docs(["one text", "one text", "another text", None], [None, None, None, 4]).select("doc_id", "text", "lang", "source", "n_chars")
    for name, df in (("none", docs.limit(0)), ("ids", docs)):
        base = tmp_path / name
        df.write.parquet(str(base / "documents.parquet"))
        shutil.copy(tmp_path / "benchmark.parquet", base / "benchmark.parquet")
        rows = corpus_pipeline.run(spark, str(base)).collect()
        assert {r.decoded_sha256 for r in rows} == (set() if name == "none" else {hashlib.sha256(t).hexdigest() for t in (b"one text", b"another text")})
        assert len(rows) == (0 if name == "none" else 2)
