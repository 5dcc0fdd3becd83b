import time

from pyspark.sql import functions as F

from warpline import schemas
from warpline.operators import cluster, enrich, graph, ingest
from warpline.plans import fixtures
from warpline.session import checkpoint_folder, children
from warpline.sources import feeds
from warpline.streaming import jobs
from warpline.streaming.graph_store import GraphStore

SF = "/root/testdata/sf0.001"


def test_jobs_add_nothing_twice(spark, tmp_path):
    store = jobs.Store(spark, str(tmp_path))
    ind = ingest.indicators(ingest.judged(fixtures.ioc(spark, SF))).persist()
    refs = fixtures.references(spark, SF)
    assert jobs.enrich_pending(store, ind, *refs).count() == ind.count()
    assert jobs.enrich_pending(store, ind, *refs).count() == 0
    nodes, edges = jobs.build_graph(store, ind)
    n = edges.count()
    assert n > 0 and nodes.count() == nodes.select("label", "value").distinct().count()
    assert jobs.build_graph(store, ind)[1].count() == n
    found = jobs.run_campaigns(store, ind)
    stored = store.read("campaigns", schemas.CAMPAIGNS)
    ids = found.select("campaign_id").distinct().count()
    assert stored.count() == ids > 0
    jobs.run_campaigns(store, ind)
    assert store.read("campaigns", schemas.CAMPAIGNS).count() == ids
    one = stored.first().campaign_id
    assert [r.event_value for r in jobs.timeline(store, one).collect()] == [one]
    assert jobs.materialise_scores(store, found).filter("strength in ('low', 'medium')").count() == found.count()
    ind.unpersist()


def test_feed_table(spark, tmp_path):
    store = jobs.Store(spark, str(tmp_path))
    runs = lambda *r: spark.createDataFrame(list(r), "name string, count long, success boolean, seq long")
    first = jobs.update_feeds(store, runs(("a", 50, True, 1), ("b", 1, True, 1))).collect()
    again = jobs.update_feeds(store, runs(("a", 200, False, 2))).collect()
    assert {(r.name, r.indicators_collected, r.status) for r in again} == {("a", 200, "failed"), ("b", 1, "success")}
    assert {r.name: r.last_run for r in first} == {r.name: r.last_run for r in again}


def test_answer_of_a_feed_run(spark):
    r = feeds.Registry()
    r.register(feeds.Feed("one", lambda s: s.createDataFrame([("\n".join(f"{i}.com" for i in range(30)),)], "value string"), feeds.otx))
    got = feeds.answer(r.run(spark)).first()
    assert got.indicators_collected == 30 and [x.value for x in got["sample"]] == [f"{i}.com" for i in range(10)]


def test_failed_enrichment_stores_nothing(spark, tmp_path):
    store = jobs.Store(spark, str(tmp_path))
    ind = spark.createDataFrame([(1, "evil.com", "domain", "s", 5)], "id long, value string, type string, source string, confidence int")
    asn, dns, who = fixtures.references(spark, SF)
    bad = dns.withColumn("domain", F.raise_error(F.lit("look-up failed")).cast("string"))
    assert jobs.enrich_pending(store, ind, asn, bad, who).count() == 0
    assert store.read("enrichment", schemas.ENRICHMENT).count() == store.read("timeline", schemas.TIMELINE).count() == 0
    assert jobs.enrich_pending(store, ind, asn, dns, who).count() == 1
    assert store.read("timeline", schemas.TIMELINE).count() == 1


def test_loop_goes_on_after_a_failure(spark, tmp_path):
    ran = []

    def job():
        ran.append(1)
        if len(ran) == 1:
            raise RuntimeError("once")

    q = jobs.every(spark, 1, job, str(tmp_path / "c"))
    for _ in range(40):
        if len(ran) >= 3:
            break
        time.sleep(0.5)
    active = q.isActive
    q.stop()
    assert active and len(ran) >= 3


def test_loop(spark, tmp_path):
    ran = []
    q = jobs.every(spark, 1, lambda: ran.append(1), str(tmp_path / "c"))
    for _ in range(40):
        if len(ran) >= 2:
            break
        time.sleep(0.5)
    q.stop()
    assert len(ran) >= 2


def test_a_graph_grows_by_what_is_new(spark, tmp_path):
    """Three deltas and a removal equal one rebuild; buckets that a delta doesn't touch keep their files; a run counts once."""
    ind = ingest.indicators(ingest.judged(fixtures.ioc(spark, SF))).persist()
    enr = enrich.enrich(ind, *fixtures.references(spark, SF)).persist()
    rows = lambda df: sorted(map(str, df.collect()))
    part = lambda *k: (ind.filter((F.xxhash64("id") % 5).isin(*k)), enr.filter((F.xxhash64("indicator_id") % 5).isin(*k)))
    store = GraphStore(spark, str(tmp_path / "g"), buckets=64)
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "g" / "edges").rglob("part-*.parquet")}
    for run, k in enumerate(((0, -1, 1), (2, -2), (3, -3, 4)), 1):
        store.apply(run, part(*k))
    one = (ind.limit(1).persist(), enr.join(ind.limit(1).select(F.col("id").alias("indicator_id")), "indicator_id", "left_semi").select(enr.columns))
    before = files()
    written = store.apply(4, part(-4))
    kept = {p for p, t in files().items() if before.get(p) == t}
    assert {int(p.split("bucket=")[1].split("/")[0]) for p in set(before) - kept} <= written["edges"] and 0 < len(written["edges"]) <= 64
    assert rows(store.edges()) == rows(graph.edges(ind, enr)) and rows(store.nodes()) == rows(graph.nodes(ind, graph.edges(ind, enr)))
    assert store.apply(4, part(-4)) == {"edges": set(), "own": set()}
    before = files()
    written = store.apply(5, (ind.limit(0), enr.limit(0)), one)
    assert 0 < len(written["edges"]) < 20 and len([p for p, t in files().items() if before.get(p) == t]) >= len(before) - len(written["edges"])
    left = ind.join(one[0].select("id"), "id", "left_anti")
    less = graph.edges(left, enr)
    assert rows(store.edges()) == rows(less) and rows(store.nodes()) == rows(graph.nodes(left, less))
    store.apply(6, one)
    assert rows(store.edges()) == rows(graph.edges(ind, enr))
    ind.unpersist()


def test_graph_job_takes_late_enrichment_and_finishes_stopped_runs(spark, tmp_path, monkeypatch):
    store = jobs.Store(spark, str(tmp_path))
    ind = ingest.indicators(ingest.judged(fixtures.ioc(spark, SF))).persist()
    asn, dns, who = fixtures.references(spark, SF)
    rows = lambda df: sorted(map(str, df.collect()))
    real, calls = GraphStore._apply, []

    def stops(self, kind, delta, run):
        calls.append(kind)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return real(self, kind, delta, run)

    monkeypatch.setattr(GraphStore, "_apply", stops)
    try:
        jobs.build_graph(store, ind)  # edges are written, own is not
        raise AssertionError
    except RuntimeError:
        pass
    none = enrich.enrich(ind, asn.limit(0), dns.limit(0), who.limit(0)).limit(0)
    nodes, edges = jobs.build_graph(store, ind)
    assert rows(edges) == rows(graph.edges(ind, none)) and rows(nodes) == rows(graph.nodes(ind, edges))
    jobs.enrich_pending(store, ind, asn, dns, who)
    nodes, edges = jobs.build_graph(store, ind)
    enr = enrich.enrich(ind, asn, dns, who)
    assert rows(edges) == rows(graph.edges(ind, enr)) and rows(nodes) == rows(graph.nodes(ind, edges))
    ind.unpersist()


def test_campaigns_are_tracked_and_folders_stay_small(spark, tmp_path):
    store = jobs.Store(spark, str(tmp_path / "s"))
    ind = ingest.indicators(ingest.judged(fixtures.ioc(spark, SF))).persist()
    jobs.enrich_pending(store, ind, *fixtures.references(spark, SF))
    half = ind.filter("id < 2e13 or id > 4e13")
    jobs.run_campaigns(store, half)
    first = jobs.track_campaigns(store, jobs.run_campaigns(store, half))
    assert first.count() > 0 and store.read("timeline", schemas.TIMELINE).filter("event_type like 'indicator_%ed' and source is null").count() == 0
    found = jobs.run_campaigns(store, ind)
    values = cluster.by_value(store.read("enrichment", schemas.ENRICHMENT), ind)
    assert sorted(map(str, found.select("indicators").collect())) == sorted(map(str, cluster.as_arrays(cluster.clusters(values)).select("indicators").collect()))
    folder = checkpoint_folder(spark)
    before = children(spark, folder)
    jobs.track_campaigns(store, found)
    for _ in range(2):
        found = jobs.run_campaigns(store, ind)
        jobs.build_graph(store, ind)
        now = jobs.track_campaigns(store, found)
    assert children(spark, folder) == before and len(store.numbers("memberships")) == 2
    assert now.select("campaign_id").distinct().count() == found.count()
    ind.unpersist()
