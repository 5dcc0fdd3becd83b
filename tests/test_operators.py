import random

import pytest
from pyspark.sql import functions as F

from warpline import schemas
from warpline.operators import campaigns, cluster, enrich, graph, ingest, lookup

MSG = "seq long, value string, type string, source string, confidence int"


def test_first_sighting_wins_and_all_are_kept(spark):
    rows = ingest.judged(spark.createDataFrame([(1, "8.8.8.8", "ip", "s1", 10), (2, "8.8.8.8", "ip", "s2", 20), (3, "8.8.8.8", "IP", "s3", None), (4, "bad", "ip", None, 5), (5, "x", "md5", None, 101), (6, "http://[x/", "url", "s", 5), (7, None, "ip", "s", 5)], MSG))
    ind = ingest.indicators(rows)
    assert {tuple(r) for r in ind.collect()} == {(1, "8.8.8.8", "ip", "s1", 10), (3, "8.8.8.8", "IP", "s3", 50)}
    assert {tuple(r) for r in ingest.sightings(rows, ind).collect()} == {(1, 1, "s1", 10), (2, 1, "s2", 20), (3, 3, "s3", 50)}
    assert [tuple(r) for r in ingest.rejected(rows).collect()] == [(4, "bad", "ip", "manual", "invalid ip")]
    assert ingest.only_new(ind, ind.filter("type = 'ip'")).count() == 1


def test_guard(spark):
    values = ["x", "y" * 2001, '{"data": 1}', ' {"results": 2}', '{"x": 1}', '{"data": broken', None]
    rows = spark.createDataFrame([(i, v, "t", "s", 1) for i, v in enumerate(values)], MSG)
    assert sorted(r.seq for r in ingest.guard(rows).collect()) == [0, 4, 5, 6]


def enriched_tables(spark):
    asn = spark.createDataFrame([("1.1.1.1", "AS1 One", "IspOne", "success"), ("2.2.2.2", "AS2", "IspTwo", "fail")], schemas.REF_ASN)
    dns = spark.createDataFrame([("a.com", ["NS1.a.", "ns1.A"], ["1.1.1.1", "3.3.3.3"]), ("b.github.io", None, ["1.1.1.1"]), ("c.com", [], [])], schemas.REF_DNS)
    who = spark.createDataFrame([("a.com", ["R1", "R2"]), ("c.com", [])], schemas.REF_WHOIS)
    return asn, dns, who


def test_enrichment(spark):
    ind = spark.createDataFrame([(1, "1.1.1.1", "ip"), (2, "2.2.2.2", "ip"), (3, "a.com", "domain"), (4, "https://B.github.io/x", "url"), (5, "1.1.1.1", "IP"), (6, "c.com", "domain"), (7, "f" * 32, "hash")], "id long, value string, type string").withColumns({"source": F.lit("s"), "confidence": F.lit(1)})
    e = enrich.enrich(ind, *enriched_tables(spark))
    got = {r.indicator_id: tuple(r)[1:6] for r in e.collect()}
    none = (None,) * 5
    assert got == {1: ("AS1", None, "IspOne", None, None), 2: none, 3: ("AS1", "R1", "IspOne", "ns1.a", "1.1.1.1,3.3.3.3"), 4: ("AS1", None, "GitHub Pages", None, "1.1.1.1"), 5: none, 6: none, 7: none}
    edges = {tuple(r) for r in graph.edges(ind, e).collect()}
    assert ("URL", "https://B.github.io/x", "HOSTS", "Domain", "b.github.io") in edges
    assert ("Domain", "b.github.io", "HOSTED_BY", "HostingProvider", "GitHub Pages") in edges
    assert ("Domain", "a.com", "RESOLVES_TO_IP", "IP", "3.3.3.3") in edges and ("Domain", "a.com", "USES_NS", "Nameserver", "ns1.a") in edges
    assert ("Indicator", "f" * 32, "INDICATES", "Hash", "f" * 32) in edges
    assert not any(x[1] == "1.1.1.1" and x[2] == "RESOLVES_TO_ASN" for x in edges)
    nodes = {(r.label, r.value): r for r in graph.nodes(ind, graph.edges(ind, e)).collect()}
    assert nodes["IP", "1.1.1.1"].type == "IP" and nodes["ASN", "AS1"].type is None
    assert enrich.pending(ind, e.filter("indicator_id < 7")).count() == 1


def test_bounded_reach(spark):
    edges = [("URL", "u1", "Domain", "d1"), ("Domain", "d1", "Nameserver", "n1"), ("Domain", "d2", "Nameserver", "n1"), ("URL", "u2", "Domain", "d2"), ("Domain", "d2", "Nameserver", "n2"), ("Domain", "d3", "Nameserver", "n2"), ("Domain", "d3", "Nameserver", "n3"), ("Domain", "d4", "Nameserver", "n3")]
    df = spark.createDataFrame([(a, b, "R", c, d) for a, b, c, d in edges], schemas.EDGES)
    got = {}
    for r in graph.reach(df).collect():
        got.setdefault(r.start.split("\x01")[1], set()).add(r.node.split("\x01")[1])
    assert got == {"u1": {"d1", "d2", "u2"}, "d1": {"u1", "d2", "d3", "u2"}, "u2": {"d1", "d2", "d3", "u1"}, "d2": {"d1", "d3", "d4", "u1", "u2"}, "d3": {"d1", "d2", "d4", "u2"}, "d4": {"d2", "d3"}}
    assert graph.candidates(graph.clusters(df)).filter("size < 2").count() == 0


def balls(rows, hops):
    """Distinct sorted value sets by breadth-first search."""
    near = {}
    for a, b, _, c, d in rows:
        if (a, b) != (c, d):
            near.setdefault((a, b), set()).add((c, d))
            near.setdefault((c, d), set()).add((a, b))
    out = set()
    for start in (n for n in near if n[0] in graph.TYPED):
        seen, frontier = {start}, {start}
        for _ in range(hops):
            frontier = {m for n in frontier for m in near[n]} - seen
            seen |= frontier
        out.add(tuple(sorted({v for lab, v in seen if lab in graph.TYPED})))
    return {c for c in out if len(c) > 1}


@pytest.mark.parametrize("seed", range(4))
def test_clusters_against_a_search(spark, seed):
    """Random graphs with hubs, twins, pendants, self-loops, and values under two labels."""
    rnd = random.Random(seed)
    labels = ["URL", "Domain", "IP", "Indicator", "ASN", "Nameserver"]
    node = lambda: (rnd.choice(labels), f"v{rnd.randint(0, 25)}")
    rows = [(*node(), "R", *node()) for _ in range(30)]
    rows += [("URL", f"twin{i}", "HOSTS", "Domain", "v1") for i in range(20)] + [("Indicator", f"p{i}", "INDICATES", "URL", f"twin{i}") for i in range(20)]
    rows += [("Domain", f"far{i}", "R", "Domain", f"far{i + 1}") for i in range(9)] + [("URL", "alone", "R", "URL", "alone")]
    for hops in (1, 2, 4):
        got = [tuple(r.cluster) for r in graph.clusters(spark.createDataFrame(rows, schemas.EDGES), hops).collect()]
        assert len(got) == len(set(got)) and set(got) == balls(rows, hops)


def test_clusters_around_hubs(spark):
    """5,000 leaves of two hubs: as twins they stand once, and with a neighbour of their own each they still make no pairs."""
    rows = spark.range(5000).select(F.lit("URL").alias("src_label"), F.concat(F.lit("u"), "id").alias("src_value"), F.lit("R").alias("rel"), F.lit("Domain").alias("dst_label"), F.concat(F.lit("d"), (F.col("id") % 2).cast("string")).alias("dst_value"))
    sizes = lambda df, hops: sorted(r.n for r in graph.clusters(df, hops).select(F.size("cluster").alias("n")).collect())
    assert sizes(rows, 4) == [2501, 2501]
    own = rows.withColumns({"rel": F.lit("S"), "dst_label": F.lit("IP"), "dst_value": F.concat(F.lit("ip"), "src_value")}).unionByName(rows)
    assert sizes(own, 4) == [5001, 5001]
    assert graph.clusters(rows.limit(0)).count() == 0


@pytest.mark.parametrize("block", [2, 1024])
def test_pairs_within_reach_against_a_search(spark, monkeypatch, block):
    """Each pair once, whatever the blocks; values may hold the separator of labels; labels apart, values repeat."""
    monkeypatch.setattr(graph, "BLOCK", block)
    rnd = random.Random(5)
    node = lambda: (rnd.choice(["URL", "Domain", "IP", "Indicator", "ASN"]), f"v\u0001{rnd.randint(0, 12)}")
    rows = [(*node(), "R", *node()) for _ in range(24)] + [("URL", f"twin{i}", "HOSTS", "Domain", "hub") for i in range(9)] + [("Indicator", "p", "INDICATES", "IP", "lone")]
    near = {}
    for a, b, _, c, d in rows:
        if (a, b) != (c, d):
            near.setdefault((a, b), set()).add((c, d))
            near.setdefault((c, d), set()).add((a, b))
    for hops in (0, 1, 2, 4):
        want = []
        for start in (n for n in near if n[0] in graph.TYPED):
            seen = {start}
            for _ in range(hops):
                seen |= {m for n in seen for m in near[n]}
            want += [(start, n) for n in seen if n[0] in graph.TYPED and n != start]
        df = spark.createDataFrame(rows, schemas.EDGES)
        assert sorted(map(tuple, graph.reach(df, hops).collect())) == sorted(("\u0001".join(a), "\u0001".join(b)) for a, b in want)
        assert sorted(map(tuple, graph.reach_values(df, hops).collect())) == sorted((a[1], b[1]) for a, b in want)


def test_pairs_within_reach_are_written_out_last(spark, monkeypatch):
    """600 leaves of a hub, each with a neighbour of its own: 1.4 million pairs, and no stored table has a fiftieth as many rows."""
    sizes = []
    real = graph.checkpointed

    def stored(df):
        out = real(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "checkpointed", stored)
    rows = [("URL", f"u{i}", "R", "Domain", "hub") for i in range(600)] + [("URL", f"u{i}", "R", "IP", f"ip{i}") for i in range(600)]
    assert graph.reach(spark.createDataFrame(rows, schemas.EDGES)).count() == 1201 * 1200
    assert max(sizes) < 1201 * 1200 / 50


def test_a_start_meets_one_list_at_a_time(spark):
    """Generated code keeps all that one input row explodes to: in the last stage that is one list of nodes, not one for each node of another list."""
    rows = [("URL", f"u{i}", "R", "Domain", "hub") for i in range(3000)] + [("Domain", "u7", "R", "Domain", "hub")]
    df = graph.reach_values(spark.createDataFrame(rows, schemas.EDGES))
    last = df._jdf.queryExecution().executedPlan().toString().partition("Exchange")[0]
    assert last.count("Generate explode") == 1 and "SortMergeJoin" in last
    assert df.count() == 3002 * 3001
    assert df.filter("start = node").collect() == [("u7", "u7")] * 2
    assert df.distinct().count() == 3001 * 3000 + 1


def sequential(items):
    """Greedy leader clustering as a plain loop: (pos, value, features) in order."""
    close = lambda a, b: bool(a) and bool(b) and len(a & b) / len(a | b) >= 0.75
    seen, out = set(), {}
    for i, (p, _, f) in enumerate(items):
        if p in seen:
            continue
        seen.add(p)
        members = [p]
        for q, _, g in items[i + 1 :]:
            if close(f, g):
                members.append(q)
                seen.add(q)
        if len(members) > 1:
            out[p] = members
    return out


@pytest.mark.parametrize("seed", range(4))
def test_leader_clusters_against_a_loop(spark, seed):
    rnd = random.Random(seed)
    items = [(i, f"v{i}", set(rnd.sample("abcdefg", rnd.randint(0, 7)))) for i in range(25)]
    df = spark.createDataFrame([(p, v, sorted(f)) for p, v, f in items], "pos long, value string, fp array<string>")
    got = {}
    for r in cluster.clusters(df).collect():
        got.setdefault(r.leader, []).append(r.member_pos)
    assert {k: sorted(v) for k, v in got.items()} == sequential(items)


def test_ten_appends_equal_one_run(spark, tmp_path):
    rnd = random.Random(0)
    items = [(i, f"v{i}", sorted(rnd.sample("abcdefgh" if i < 30 else "abcdefghxyz", rnd.randint(0, 7)))) for i in range(80)]
    df = spark.createDataFrame(items, "pos long, value string, fp array<string>")
    key = lambda rows: sorted((r.leader, r.member_pos, r.member) for r in rows.collect())
    grown = cluster.Leaders(spark, str(tmp_path / "l"))
    cuts = [0, 1, 9, 15, 30, 31, 44, 50, 62, 70, 80]
    for run, (a, b) in enumerate(zip(cuts, cuts[1:])):
        grown.append(df.filter(F.col("pos").between(a, b - 1)), run)
    want = key(cluster.clusters(df))
    assert key(grown.members()) == want != []
    grown.append(df.filter(F.col("pos") >= 70), 9)  # the last append once more
    grown.append(df, 10)  # nothing new
    assert key(grown.members()) == want
    with pytest.raises(ValueError):
        grown.append(spark.createDataFrame([(5, "early", ["a"])], df.schema), 11)
    with pytest.raises(ValueError):
        grown.append(spark.createDataFrame([(90, "v3", ["q"])], df.schema), 11)
    grown.rebuild(df, 12)
    assert key(grown.members()) == want


def test_an_append_reads_no_old_fingerprints(spark, tmp_path):
    """Buckets of the new features are all that is read of the index, and the second run makes pairs of new rows only."""
    grown = cluster.Leaders(spark, str(tmp_path / "l"))
    fp = lambda i: [f"f{i}{k}" for k in "abcd"]
    rows = lambda r: spark.createDataFrame([(i, f"v{i}", fp(i % 100)) for i in r], "pos long, value string, fp array<string>")
    grown.append(rows(range(100)), 0)
    read = []
    real = grown._read
    grown._read = lambda name, *a: read.append((name, a, real(name, *a))) or read[-1][2]
    grown.append(rows(range(100, 102)), 1)
    own = [(a, df) for name, a, df in read if name == "index"]
    buckets = set(own[0][0][1])
    assert len(own) == 1 and len(buckets) <= 4  # two fingerprints, two features each
    assert {f.split("bucket=")[1].split("/")[0] for f in own[0][1].inputFiles()} <= set(map(str, buckets))
    assert "members" not in [name for name, _, _ in read]
    assert sorted(r.member for r in grown.members().collect()) == ["v0", "v1", "v100", "v101"]


def test_leader_order_matters(spark):
    a, b, c = ["a", "n1", "n2", "r"], ["a", "h1", "n1", "n2", "r"], ["a", "h2", "n1", "n2", "r"]
    make = lambda fps: spark.createDataFrame([(i, x, f) for i, (x, f) in enumerate(fps)], "pos long, value string, fp array<string>")
    arrays = lambda fps: sorted(r.indicators for r in cluster.as_arrays(cluster.clusters(make(fps))).collect())
    assert arrays([("A", a), ("B", b), ("C", c)]) == [["A", "B", "C"]]
    assert arrays([("B", b), ("C", c), ("A", a)]) == [["B", "A"], ["C", "A"]]


def test_similarity(spark):
    rows = spark.createDataFrame([(["a", "r"], ["a", "h"]), ([], ["a"]), (["a"], ["a"])], "a array<string>, b array<string>")
    assert [round(r[0], 3) for r in rows.select(cluster.similarity(F.col("a"), F.col("b"))).collect()] == [0.333, 0.0, 1.0]


def test_fingerprints_skip_empty_and_addresses(spark):
    e = spark.createDataFrame([(1, "AS1", "", "H", " n1, ,n2,n1", "1.1.1.1")], "indicator_id long, asn string, registrar string, hosting_provider string, nameservers string, resolved_ips string")
    ind = spark.createDataFrame([(1, "v")], "id long, value string")
    assert cluster.by_value(e, ind).first().fp == ["asn:AS1", "hosting:H", "ns:n1", "ns:n2"]


def test_campaigns_attribution_and_feeds(spark):
    found = campaigns.identified(spark.createDataFrame([(["b.com", "a.com"],), (["login.evil.com", "x"],)], "indicators array<string>"))
    new = campaigns.new_rows(found, found.limit(0))
    assert {(r.confidence, r.strength, r.indicator_count) for r in new.collect()} == {(60, "emerging", 2)}
    assert campaigns.new_rows(found, new).count() == 0 and campaigns.created_events(new).count() == 2
    assert {r.status for r in campaigns.with_status(found, new).collect()} == {"existing"}
    rows = found.withColumns({"registrar": F.lit("Namecheap"), "asn": F.lit("AS13335")}).filter("indicators[1] = 'x'")
    best = campaigns.attribution(campaigns.actor_scores(rows)).first()
    assert (best.actor, best.score) == ("APT29", 0.8)
    blank = campaigns.attribution(campaigns.actor_scores(found.withColumns({"registrar": F.lit(None).cast("string"), "asn": F.lit("x")}).filter("indicators[0] = 'b.com'"))).first()
    assert (blank.actor, blank.score) == ("APT29", 0.0)
    runs = spark.createDataFrame([("openphish", 50, True, 1), ("openphish", 200, True, 2), ("otx", 3, False, 1)], "name string, count long, success boolean, seq long")
    assert {tuple(r) for r in campaigns.feed_status(runs).collect()} == {("openphish", 200, "success"), ("otx", 3, "failed")}


def test_look_ups(spark):
    ind = spark.createDataFrame([(1, "a_b.com", "domain"), (2, "axb.com", "domain"), (3, "1.1.1.1", "ip")], "id long, value string, type string")
    assert lookup.pivot_domain(ind, "a_b").count() == 2 and lookup.pivot_ip(ind, "1.1.1.1").count() == 1
    assert lookup.indicator(ind, 9).count() == 0 and lookup.health(spark).first().ok == 1
    ev = spark.createDataFrame([(2, "c", 5), (1, "c", 5), (3, "c", 1), (4, "d", 0)], "id long, campaign_id string, created_at long")
    assert [r.id for r in lookup.timeline(ev, "c").collect()] == [3, 1, 2]
    assert lookup.envelope(ind).filter("status = 'success'").count() == 3
