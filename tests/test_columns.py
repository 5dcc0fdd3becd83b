import pytest
from pyspark.sql import functions as F

from warpline.functions import columns as C


def apply(spark, pairs, f):
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, v string, t string").select("i", f(F.col("v"), F.col("t")).alias("x"))
    return [r.x for r in rows.orderBy("i").collect()]


VALID = [
    ("evil.com", "domain", True), ("evil..com", "domain", False), ("Evil.com", "domain", False), ("-evil.com", "domain", False), ("evil-.com", "domain", True),
    ("evil.com\n", "domain", True), ("evil.com\n\n", "domain", False), ("x" * 64 + ".com", "domain", False), ("x" * 63 + ".com", "domain", True), ("a.c", "domain", False), ("com", "domain", False),
    ("8.8.8.8", "ip", True), ("999.999.999.999", "ip", False), ("01.2.3.4", "ip", False), ("1.2.3", "ip", False), (" 1.2.3.4", "ip", False), ("1.2.3.4\n", "ip", False),
    ("::1", "ip", True), ("::", "ip", True), ("fe80::1%eth0", "ip", True), ("fe80::1%", "ip", False), ("fe80::1%a%b", "ip", False), ("::ffff:1.2.3.4", "ip", True), ("1:2:3:4:5:6:7:8", "ip", True), ("1:2:3:4:5:6:7", "ip", False),
    ("1::2:3:4:5:6:7", "ip", True), ("1::2:3:4:5:6:7:8", "ip", False), ("1:2:3:4:5:6:1.2.3.4", "ip", True), ("12345::", "ip", False), (":1", "ip", False), ("1::2::3", "ip", False), ("1.2.3.4%eth0", "ip", False), ("1:2:3:4:5:6:7::", "ip", True), ("::1.2.3.4:5", "ip", False),
    ("evil.com/x", "url", False), ("http://", "url", False), ("//evil.com/x", "url", False), ("http://evil.com", "url", True), (" http://evil.com", "url", True), ("ht\ttp://evil.com", "url", True), ("1http://x.com", "url", False),
    ("a" * 32, "hash", True), ("z" * 64, "HASH", True), ("abcd1234", "hash", False), ("anything", "md5_hash", True), ("EVIL", "other", True),
]


def test_validation(spark):
    got = apply(spark, [(v, t) for v, t, _ in VALID], C.valid)
    assert got == [ok for *_, ok in VALID]


def test_ip_rules_against_the_standard_library(spark):
    import ipaddress
    import random

    rnd = random.Random(9)
    values = ["".join(rnd.choice([":", "::", ".", "1", "ff", "0", "255", "256", "abcd", "%", "g"]) for _ in range(rnd.randint(1, 12))) for _ in range(3000)]

    def want(v):
        try:
            ipaddress.ip_address(v)
            return True
        except ValueError:
            return False

    assert apply(spark, [(v, "ip") for v in values], C.valid) == [want(v) for v in values]


def test_url_parts_against_the_standard_library(spark):
    from urllib.parse import urlparse

    urls = ["http://under_score.com/x", "http://münchen.de/x/", "http://a.com;x/p;q", "http://bad host/x", "http://e.com/a b|c", "HTTPS://U:p@H:80/a/b//?q#f", "mailto:x", "//h/p", "/p;x", "a/b;c/d;e;f", "", "http:///p", "x:y", "  http://a.b/c", "ht\ntp://a/b", "ftp://h/p;t=a", "gopher://h/p;t"]
    for part, name in ((C.scheme, "scheme"), (C.netloc, "netloc"), (C.path, "path")):
        assert apply(spark, [(u, "") for u in urls], lambda v, t, p=part: p(v)) == [getattr(urlparse(u), name) for u in urls]


NORMAL = [
    ("https://WWW.Example.com", "domain", "example.com"), ("  www.A.b ", "domain", "a.b"), ("HTTP://example.com/test/", "url", "http://example.com/test"),
    ("https://u:p@Evil.com:8080/a/b//?q=1#f", "url", "https://u:p@evil.com:8080/a/b"), ("http://a.com/p;x", "url", "http://a.com/p"), (" ABCDEF ", "hash", "abcdef"), (" 8.8.8.8 ", "ip", "8.8.8.8"), (" Keep ", "md5", " Keep "), ("\x1c x\x1f", "ip", "x"),
]


def test_normalisation(spark):
    assert apply(spark, [(v, t) for v, t, _ in NORMAL], C.normal) == [x for *_, x in NORMAL]


def test_reason_and_hosting(spark):
    assert apply(spark, [("x", "Domain"), ("8.8.8.8", "ip"), ("q", "hash")], C.reason) == ["invalid domain", None, "invalid hash"]
    assert apply(spark, [("foo.github.io", ""), ("evilgithub.io", ""), ("x.com", "")], lambda v, t: C.hosting(v)) == ["GitHub Pages", "GitHub Pages", None]


def test_lists_and_tokens(spark):
    rows = spark.createDataFrame([([" NS1.a ", "ns1.A", "", None, "b"],), ([],), (None,)], "a array<string>")
    assert [r[0] for r in rows.select(C.clean_list(F.col("a"))).collect()] == ["ns1.a,b", None, None]
    assert apply(spark, [("AS13335 Cloudflare, Inc.", ""), ("", ""), ("  x y", ""), (None, "")], lambda v, t: C.asn_token(v)) == ["AS13335", None, "x", None]
    assert apply(spark, [("ns1.example.com.", "")], lambda v, t: C.undotted(v)) == ["ns1.example.com"]


@pytest.mark.parametrize(
    ("members", "score", "strength"),
    [(["evil.com", "1.1.1.1", "http://evil.com/login"], 35, "low"), ([f"{i}.com" for i in range(8)] + ["http://x", "ab"], 70, "medium"), (["a.b", "c.d"], 15, "low"), (["::1", "x.y", "http://q", "a.b", "b.c"], 55, "medium")],
)
def test_scores(spark, members, score, strength):
    r = spark.createDataFrame([(members,)], "m array<string>").select(C.score(F.col("m")).alias("s"), C.strength(C.score(F.col("m"))).alias("c"), C.campaign_id(F.col("m")).alias("i"), C.campaign_id(F.reverse("m")).alias("j")).first()
    assert (r.s, r.c) == (score, strength) and r.i == r.j and r.i.startswith("campaign_")


def test_techniques(spark):
    assert apply(spark, [("login-update.auth.net", ""), ("Login", ""), ("", "")], lambda v, t: C.technique(v, C.DOMAIN_KEYWORDS)) == [["T1566", "T1078", "T1105"], [], []]
