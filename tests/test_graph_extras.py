"""Components, derived edges and trigram pivots."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from warpline.operators import components, enrich, lookup, relations, trigrams
from warpline.plans import fixtures as X
from warpline.plans import registry

SF = "/root/testdata/sf0.001"


def union_find(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root}


def of(df):
    return {r.node: r.component for r in df.collect()}


@pytest.mark.parametrize("seed", range(2))
def test_components_against_union_find(spark, seed):
    rnd = random.Random(seed)
    links = [(f"n{rnd.randint(0, 60)}", f"n{rnd.randint(0, 60)}") for _ in range(40)] + [("self", "self"), ("x", None), (None, "y"), ("n1", "n1")]
    df = spark.createDataFrame(links, "a string, b string")
    assert of(components.components(df)) == union_find(links)
    assert components.components(df.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark, monkeypatch):
    """10,000 nodes in a row and 10,000 around a hub: rounds by the logarithm."""
    rounds = []
    real = components.checkpointed
    monkeypatch.setattr(components, "checkpointed", lambda df: rounds.append(df.columns) or real(df))
    path = spark.range(10_000).select(F.concat(F.lit("p"), "id").alias("a"), F.concat(F.lit("p"), F.col("id") + 1).alias("b"))
    star = spark.range(10_000).select(F.lit("hub").alias("a"), F.concat(F.lit("s"), "id").alias("b"))
    got = components.components(path.unionByName(star)).groupBy("component").agg(F.count("*").alias("n"))
    assert {(r.component, r.n) for r in got.collect()} == {("p0", 10_001), ("hub", 10_001)}
    assert rounds.count(["u", "m"]) <= 14


def test_related_pairs_against_a_loop(spark):
    rnd = random.Random(3)
    links = {(f"d{rnd.randint(0, 30)}", f"h{min(rnd.randint(0, 9), rnd.randint(0, 9))}") for _ in range(90)}
    degree = Counter(h for _, h in links)
    hubs = {n: sorted((degree[h], h) for m, h in links if m == n) for n, _ in links}
    near = set()
    for hub in degree:
        order = sorted((n for n, h in links if h == hub), key=lambda n: ("\x02".join(h for _, h in hubs[n]), n))
        near |= {tuple(sorted((a, b))) for i, a in enumerate(order) for b in order[i + 1 : i + 3]}
    score = {p: (round(sum(1 / degree[h] for _, h in set(hubs[p[0]]) & set(hubs[p[1]])), 9), len(set(hubs[p[0]]) & set(hubs[p[1]]))) for p in near}
    best = set()
    for n in hubs:
        own = sorted((p for p in near if n in p), key=lambda p: (-score[p][0], p[1] if p[0] == n else p[0]))
        best |= set(own[:2])
    got = {(r.a, r.b): (r.weight, r.shared) for r in relations.related(spark.createDataFrame(sorted(links), "node string, hub string"), span=2, best=2).collect()}
    assert got == {p: score[p] for p in best}


def test_a_hub_of_many_makes_no_square(spark):
    links = spark.range(20_000).select(F.concat(F.lit("d"), "id").alias("node"), F.lit("hub").alias("hub"))
    assert relations.scored_pairs(links).count() == 3 * 20_000 - 6
    assert relations.related(links.limit(1)).count() == 0


def test_trigram_pivot_equals_a_scan_and_reads_few_files(spark, tmp_path):
    ind = registry._indicators(spark, SF).persist()
    grown = trigrams.Postings(spark, str(tmp_path / "t"), buckets=128)
    grown.append(ind.filter("id % 3 = 0"), 1)
    grown.append(ind.filter("id % 3 <> 0"), 2)
    grown.append(ind.filter("id % 3 <> 0"), 2)  # once more
    own = lambda df: sorted(map(str, df.select(ind.columns).collect()))
    for text in ("example.n_t", "evil", "login-upd%net", "nothing-like-it", "a%", "_", "", "e_e", "8.8.8.8", "é", "a\\%b", "github", "%%%com", "HTTP"):
        assert own(grown.pivot(text)) == own(lookup.pivot_domain(ind, text)), text
    whole = len(grown._read("rows").inputFiles())
    assert len(grown.pivot("login-update").inputFiles()) < whole / 4
    ind.unpersist()


def test_of_several_answers_the_least_counts(spark):
    dns = spark.createDataFrame([("a.com", ["ns2.a."], ["2.2.2.2"]), ("a.com", ["ns1.a."], ["3.3.3.3"]), ("a.com", [], [])], "domain string, nameservers array<string>, ips array<string>")
    who = spark.createDataFrame([("a.com", ["R2"]), ("a.com", ["R1", "R3"]), ("a.com", [])], "domain string, registrar array<string>")
    for order in (F.col("domain"), F.rand()):
        assert tuple(enrich.dns_facts(dns.orderBy(order)).first()) == ("a.com", "ns1.a", "3.3.3.3", "3.3.3.3")
        assert [tuple(r) for r in enrich.registrar_facts(who.orderBy(order)).collect()] == [("a.com", "R1")]


def test_pivot_with_related_rows(spark):
    got = {(r.rel, r.label) for r in registry.pivot_related(spark, SF).collect()}
    assert ("RESOLVES_TO_IP", "Domain") in got
    assert X.read(spark, SF, "pages").count() == 50
