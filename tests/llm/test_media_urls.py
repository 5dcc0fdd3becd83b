import bisect
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from warpline.llm import media, urlrules


@pytest.mark.parametrize("shape", [(5, 7), (5, 7, 3), (1, 64)])
def test_bmp_and_netpbm_round_trip(shape):
    a = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    assert (media.decode(media.encode_bmp(a)) == a).all()
    if a.ndim == 2:
        assert (media.decode(media.encode_pgm(a)) == a).all()
    kind = b"P6" if a.ndim == 3 else b"P5"
    assert (media.decode(kind + b"\n# note\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + a.tobytes()) == a).all()


def test_plain_netpbm():
    assert media.decode(b"P1\n2 2\n1 0\n0 1\n").tolist() == [[0, 255], [255, 0]]
    assert media.decode(b"P4\n2 1\n\x80").tolist() == [[0, 255]]
    assert media.decode(b"P2\n2 1\n3\n0 3\n").tolist() == [[0, 255]]


def test_area_resize_is_exact():
    a = np.random.default_rng(2).integers(0, 256, (6, 9)).astype(np.uint8)
    fine = np.kron(a.astype(float), np.ones((8, 9)))
    brute = fine.reshape(8, 6, 9, 9).mean(axis=(1, 3))
    assert np.allclose(media.resize(a, 8, 9), brute)


def test_store_and_digest(spark, make_docs):
    texts = ["", None, "abc", "é" * 64, "abc", "x" * 10_000]
    rows = {r.doc_id: r for r in media.describe_texts(make_docs(texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-64:])
        stored = media.encode_pgm(np.frombuffer(padded, np.uint8).reshape(-1, 64))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        small = media.tile(media.decode(stored))
        assert r.feature == media.dhash(small) and r.tile_sha256 == hashlib.sha256(media.npy(small)).hexdigest() and r.bmp_equal
    assert rows[2][1:] == rows[4][1:]
    assert media.describe_texts(make_docs([])).count() == 0


def test_what_is_written_can_be_read_by_others(spark, make_docs):
    """The tables hold plain PGM and NPY files."""
    stored = media.store_texts(make_docs(["some text"]))
    assert bytes(stored.first().media).startswith(b"P5\n64 1\n255\nsome text")
    assert np.load(__import__("io").BytesIO(bytes(media.tiles(stored).first().tile_npy))).shape == (8, 9)


def test_broken_headers_never_crash(spark):
    rng, out = np.random.default_rng(4), []
    good = [b"P%d\n3 2\n255\n" % k + bytes(range(18)) for k in (5, 6)] + [b"P2\n2 1\n3\n0 3\n", b"P1\n2 2\n1 0\n0 1\n", b"P4\n2 1\n\x80", media.encode_bmp(np.eye(5, dtype=np.uint8)), media.encode_bmp(np.ones((2, 3, 3), np.uint8))]
    for g in good:
        for _ in range(60):
            m = bytearray(g)
            for _ in range(rng.integers(1, 4)):
                m[rng.integers(0, min(len(m), 60))] = rng.choice([0, 32, 48, 57, 45, 255])
            out.append(bytes(m[: rng.integers(1, len(m) + 1)]))
    out += [b"P5\n99999999999999 99999999999999\n255\n", b"P5\n0 0\n255\n", b"P5\n1 1\n0\nx", b"P2\n1 1\n255\n99999999999999999999999\n", b"BM" + bytes(60), b"P5", b"P", b"BM"]
    df = spark.createDataFrame([(bytearray(m),) for m in out], "media binary")
    rows = media.featurise(df).collect()
    assert len(rows) == len(out) and all(r.height is None for r in rows[-8:])


def test_featurise_keeps_unreadable_rows(spark):
    df = spark.createDataFrame([(bytearray(media.encode_pgm(np.eye(9, dtype=np.uint8) * 200)),), (None,), (bytearray(b"junk"),)], "media binary")
    got = media.featurise(df).collect()
    assert sorted(r.height or 0 for r in got) == [0, 0, 9]


def test_featurise_keeps_all_columns(spark):
    df = spark.createDataFrame([(7, bytearray(media.encode_pgm(np.eye(9, dtype=np.uint8) * 200)), "x"), (8, None, None)], "id long, media binary, `a.b` string")
    got = media.featurise(df)
    assert got.columns == ["id", "media", "a.b", "height", "width", "tile_npy", "dhash"]
    assert sorted((r[0], r[2], r.height) for r in got.collect()) == [(7, "x", 9), (8, None, None)]
    with pytest.raises(ValueError):
        media.featurise(got)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 100])
def test_places_among_edges(spark, n):
    edges = sorted(f"k{i * 7 % 103:03d}" for i in range(n))
    keys = sorted({f"k{i:03d}" for i in range(104)} | set(edges) | {"", "z"})
    df = spark.createDataFrame([(k,) for k in keys], "key string").select("key", urlrules._place(edges, F.col("key")).alias("p"))
    assert {r.key: r.p for r in df.collect()} == {k: bisect.bisect_right(edges, k) for k in keys}


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"), ("block", "a.example.com", ""), ("allow", "example.com", "/en/7"), ("block", None, "/x"), ("block", "", "/"), ("block", "a\u0001.net", "/")]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1].split("#")[0].split("?")[0]
        host, _, path = rest.partition("/")
        path = "/" + path if "/" in rest else ""
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


@pytest.mark.parametrize(("chunk", "keys"), [(3, 40), (20_000, 200_000)])
def test_rules_against_brute_force(spark, monkeypatch, chunk, keys):
    monkeypatch.setattr(urlrules, "CHUNK", chunk)
    monkeypatch.setattr(urlrules, "KEYS", keys)
    hosts = ["com", "Example.COM", "b.example.com", "a.example.com", "x.a.example.com", "xexample.com", "example.net", "m.example.net", "w.org", "", "Ü.com", "com.net", "zz", "com\u0001x", "a\u0001.net", "x.a\u0001.net", "a.net", "\U0010ffffz.example.com", "b\u0001.example.com", "\u0002.com", "com\u0002\u0004x"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/7x", "/en/1", "/de/8", "/de/1?a=/en/", "#/en/", "/es/?x://y")] + [None, "", "no", "x://", "://com/en/", "http://com/en/"]
    pages = spark.createDataFrame([(i, u, "h", "k", "r") for i, u in enumerate(urls)], "page_id long, url string, html string, key string, rule string")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    got = {r.page_id: tuple(r)[1:] for r in urlrules.match(pages, rules).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)}
    assert urlrules.match(pages.limit(0), rules).count() == 0
    assert {r.rule for r in urlrules.match(pages, rules.limit(0)).collect()} == {None}


def test_many_nested_path_rules_of_one_host(spark, monkeypatch):
    """Runs cut inside a host's nest of rules; repeated pages keep their rows; no event carries more than one rule."""
    monkeypatch.setattr(urlrules, "CHUNK", 4)
    rules = [("block" if i % 2 else "allow", "h.com", "/" + "a/" * i) for i in range(12)] + [("block", "h.com", "/a/b"), ("allow", "com", ""), ("block", "x.h.com", "/a/a/")]
    df = spark.createDataFrame(rules, "verdict string, host string, path string")
    urls = [f"http://{h}/{'a/' * i}{t}" for h in ("h.com", "x.h.com", "com", "y.com") for i in range(14) for t in ("", "b", "c?/a/")]
    pages = spark.createDataFrame([(i // 2, u) for i, u in enumerate(urls + urls)], "page_id long, url string")
    fits = lambda host, path: max(((len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, 0, None, "allow"))[2:]
    want = sorted((i // 2, *fits(u.split("/")[2], "/" + u.split("/", 3)[3].split("?")[0])) for i, u in enumerate(urls + urls))
    assert sorted((r.page_id, r.rule, r.verdict) for r in urlrules.match(pages, df).collect()) == want
    assert "array" not in str(urlrules._events(df).schema["top"].dataType).lower()
