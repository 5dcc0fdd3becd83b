"""Evidence, lifecycle and attribution of campaigns against plain loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from warpline.operators import campaigns, evidence, lifecycle
from warpline.plans import fixtures as X
from warpline.plans import registry

SF = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(3))
def test_overlaps_against_all_pairs(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice("abcd") if i % 3 else "hot", rnd.randint(0, 30), rnd.randint(0, 30)) for i in range(150)] + [("one", 1, 2), ("two", 1, None), ("two", 3, 4)]
    want = {}
    for g in {r[0] for r in rows}:
        own = [sorted(r[1:]) for r in rows if r[0] == g and None not in r]
        pairs = list(itertools.combinations(own, 2))
        want[g] = (len(own), len(pairs), sum(x[0] <= y[1] and y[0] <= x[1] for x, y in pairs))
    df = spark.createDataFrame(rows, "g string, first long, last long")
    assert {r.g: tuple(r)[1:] for r in evidence.overlaps(df, "g").collect()} == want
    assert evidence.overlaps(df.limit(0), "g").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_similar_texts_against_all_pairs(spark, seed):
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice("ab" if n < 6 else "abcdef.") for _ in range(n))
    texts = [word(rnd.randint(0, 14)) for _ in range(120)] + ["a" * k for k in range(12)] + ["aaaaaaaaaa", "aaabaaabaa", "", "é", "日本", "日x本"]
    for t in texts[:40]:  # near copies
        at = rnd.randint(0, len(t))
        texts.append(t[:at] + rnd.choice("xa") + t[at + rnd.randint(0, 1) :])
    rows = [(i % 2, t) for i, t in enumerate(texts)] + [(0, None), (0, texts[0]), (1, texts[1])]
    want = {(g, a, b) for g in (0, 1) for a, b in itertools.combinations(sorted({t for h, t in rows if h == g and t is not None}, key=lambda t: t.encode()), 2) if distance(a, b) <= 2}
    got = [tuple(r) for r in evidence.similar(spark.createDataFrame(rows, "g int, text string"), "g").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_similar_domains_of_all_pages(spark):
    hosts = X.hosts(spark, SF).select("registrar", "value").collect()
    want = {(x.registrar, *sorted((x.value, y.value))) for x, y in itertools.combinations(hosts, 2) if x.registrar == y.registrar and distance(x.value, y.value) <= 2}
    assert {tuple(r) for r in registry.similar_domains(spark, SF).collect()} == want


def test_signals(spark):
    members = spark.createDataFrame([("c", m) for m in ("evil1.com", "evil2.com", "other.org", "evil1.com")] + [("d", "x.com"), ("d", "unlike.net")], "campaign_id string, member string")
    features = spark.createDataFrame([("evil1.com", ["asn:1", "ns:a"]), ("evil2.com", ["asn:1", "hosting:h"]), ("other.org", ["ns:b", "hosting:h"]), ("x.com", ["asn:1"])], "member string, fp array<string>")
    sights = spark.createDataFrame([("evil1.com", 1), ("evil1.com", 9), ("evil2.com", 5), ("other.org", 9), ("x.com", 1), ("unlike.net", 2)], "member string, at long")
    got = {r.campaign_id: r.asDict() for r in evidence.signals(members, features, sights).collect()}
    assert got["c"] == {"campaign_id": "c", "shared_asn": True, "shared_nameserver": False, "shared_hosting": True, "temporal_overlap": True, "domain_similarity": True}
    assert not any(v for k, v in got["d"].items() if k != "campaign_id")
    scores = {r.campaign_id: r.evidence_score for r in campaigns.evidence(evidence.signals(members, features, sights)).collect()}
    assert scores == {"c": 0.7, "d": 0.0}


def greedy(old, new):
    """Equal sets first, then the largest overlap, ties by ids."""
    edges = [(p != q and a != b, -len(a & b), p, q) for p, a in old.items() for q, b in new.items() if a & b]
    edges = sorted((old[p] != new[q], k, p, q) for _, k, p, q in edges)
    out, left, right = {}, set(), set()
    for _, k, p, q in edges:
        if p not in left and q not in right:
            out[p] = (q, -k)
            left.add(p)
            right.add(q)
    return out


def frame(spark, sets):
    return spark.createDataFrame([(c, m) for c, ms in sets.items() for m in ms], "campaign_id string, member string")


@pytest.mark.parametrize("seed", range(4))
def test_matching_against_a_loop(spark, seed):
    rnd = random.Random(seed)
    make = lambda tag, n: {f"{tag}{i}": frozenset(rnd.sample("abcdefghijkl", rnd.randint(1, 6))) for i in range(n)}
    unique = lambda sets: {k: v for k, v in sets.items() if k == min(j for j, w in sets.items() if w == v)}
    old, new = unique(make("o", 12)), unique(make("n", 12))
    got = {r.campaign_id: (r.found_id, r.overlap) for r in lifecycle.match(frame(spark, old), frame(spark, new)).collect()}
    assert got == greedy(old, new)


def test_lifecycle_over_three_runs(spark):
    """A campaign grows under its id, loses a member, and ends; a new cluster of its first members gets another id."""
    found = lambda *sets: campaigns.identified(spark.createDataFrame([(list(s),) for s in sets], "indicators array<string>"))
    none = spark.createDataFrame([], "campaign_id string, member string")
    now, ev = lifecycle.step(none, found("ab", "xyz"))
    first = {r.campaign_id for r in now.collect()}
    ids = {tuple(sorted(x.member for x in now.filter(F.col("campaign_id") == c).collect())): c for c in first}
    ab, xyz = ids["a", "b"], ids["x", "y", "z"]
    assert sorted(map(tuple, ev.collect())) == sorted((c, "campaign_created", c) for c in first)
    now, ev = lifecycle.step(now, found("abc", "xy"))
    assert {tuple(r) for r in ev.collect()} == {(ab, "indicator_added", "c"), (xyz, "indicator_removed", "z")}
    now, ev = lifecycle.step(now, found("abcd", "ab"))  # "ab" is the digest that the grown campaign keeps
    got = {tuple(r) for r in ev.collect()}
    new = next(c for c, kind, _ in got if kind == "campaign_created")
    assert got == {(ab, "indicator_added", "d"), (xyz, "campaign_resolved", xyz), (new, "campaign_created", new)} and new.startswith(ab + "_")
    now, ev = lifecycle.step(now, found())
    assert now.count() == 0 and {r.event_type for r in ev.collect()} == {"campaign_resolved"}
