import http.server
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from warpline.operators import ingest, ordering
from warpline.plans import fixtures
from warpline.session import checkpoint_folder, children
from warpline.sources import feeds, queue
from warpline.streaming import ingest as stream
from warpline.streaming import windows

SF = "/root/testdata/sf0.001"


def text(spark, *bodies):
    return spark.createDataFrame([(b,) for b in bodies], "value string")


def test_text_and_json_feeds(spark):
    got = [tuple(r)[:4] for r in feeds.openphish(text(spark, "\n http://a.com \r\n\nhttp://b.com http://c.com\n")).orderBy("pos").collect()]
    assert got == [(f"http://{x}.com", "url", "openphish", 80) for x in "abc"]
    assert feeds.otx(text(spark, "evil.com\n")).first().type == "domain"
    fox = feeds.threatfox(text(spark, json.dumps({"data": [{"ioc": "x.com"}, {"ioc": "1.1.1.1", "ioc_type": "ip"}, {"ioc": ""}, {"ioc": "n", "ioc_type": None}, {"ioc_type": "url"}]}), "{}"))
    assert sorted((r.value, r.type) for r in fox.fillna("-").collect()) == [("1.1.1.1", "ip"), ("n", "-"), ("x.com", "domain")]
    assert [r.value for r in feeds.malwarebazaar(text(spark, '{"data": [{"sha256_hash": "abcd1234"}, {"sha256_hash": null}, {}]}', "{}", "oops")).collect()] == ["abcd1234"]


def test_several_bodies_of_a_feed_keep_their_order(spark):
    bodies = spark.createDataFrame([("a.com\nb.com",), ("c.com\n\nd.com",), ("e.com",)], "value string").coalesce(1)
    rows = feeds.otx(bodies).withColumn("feed_ord", F.lit(0))
    assert [r.value for r in feeds.sample(rows, 4).collect()] == ["a.com", "b.com", "c.com", "d.com"]
    assert rows.select("pos").distinct().count() == 5


def test_registry_isolates_failures(spark):
    r = feeds.Registry()
    r.register(feeds.Feed("one", lambda s: text(s, "a.com"), feeds.otx))
    r.register(feeds.Feed("bad", lambda s: 1 / 0, feeds.otx))
    r.register(feeds.Feed("two", lambda s: text(s, "b.com\nc.com"), feeds.otx))
    rows = r.run(spark)
    assert [(x.feed_ord, x.value) for x in feeds.sample(rows).collect()] == [(0, "a.com"), (2, "b.com"), (2, "c.com")]
    assert feeds.Registry().run(spark).count() == 0


def test_dead_feeds_are_empty_at_run_time(spark):
    """A refused port, a status of 500, an unknown scheme and a plan that fails when run; the good feed stays."""

    class Broken(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(500)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Broken)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    r = feeds.Registry()
    try:
        for name, url in (("refused", "http://127.0.0.1:9/"), ("status", f"http://127.0.0.1:{server.server_port}/"), ("scheme", "nothing:x")):
            r.register(feeds.Feed(name, feeds.http(url, 5), feeds.otx))
        r.register(feeds.Feed("good", lambda s: text(s, "a.com\nb.com"), feeds.otx))
        assert sorted(x.value for x in r.run(spark).collect()) == ["a.com", "b.com"]
        r.register(feeds.Feed("late", lambda s: text(s, "x").select(F.raise_error(F.lit("late")).cast("string").alias("value")), feeds.otx))
        assert sorted(x.value for x in r.run(spark, isolate=True).collect()) == ["a.com", "b.com"]
        got = {x.name: (x["count"], x.success) for x in r.outcomes(spark).collect()}
        assert got == {"refused": (0, False), "status": (0, False), "scheme": (0, False), "good": (2, True), "late": (0, False)}
    finally:
        server.shutdown()


def test_http_source(spark):
    class Answer(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.headers.get("X-Key") == "k" else 403)
            self.end_headers()
            self.wfile.write(b"a.com\nb.com\n")

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    try:
        rows = feeds.Feed("h", feeds.http(url, 5, **{"X-Key": "k"}), feeds.otx).collect(spark)
        assert sorted(r.value for r in rows.collect()) == ["a.com", "b.com"]
    finally:
        server.shutdown()


def test_queue_round_trip(spark, tmp_path):
    path = str(tmp_path / "q")
    queue.push(spark.createDataFrame([("a.com", "domain", "s", 5)], queue.MESSAGE), path)
    spark.createDataFrame([("not json",), ('{"value": "b.com", "type": "domain"}',), ("[1]",)], "value string").write.mode("append").text(path)
    rows = queue.pop_all(spark, path)
    assert sorted((r.value, r.confidence) for r in rows.fillna(0).collect()) == [("a.com", 5), ("b.com", 0)]
    assert sorted((r.value, r.source, r.confidence) for r in ingest.with_defaults(rows).collect()) == [("a.com", "s", 5), ("b.com", "manual", 50)]
    assert queue.depth(spark, path).first().depth == 4


def test_stream_equals_batch(spark, tmp_path):
    q, base = str(tmp_path / "q"), str(tmp_path / "out")
    messages = fixtures.ioc(spark, SF)
    half = F.col("seq") % 20_000 == 0
    for part in (messages.filter(half), messages.filter(~half)):
        queue.push(part, q, order="seq")
        stream.start(spark, q, base).awaitTermination()
    # the order of arrival: the first push before the second, and seq within each
    messages = messages.withColumn("seq", F.when(half, F.col("seq")).otherwise(F.col("seq") + 10**15))
    rows = ingest.judged(messages)
    key = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    for name, want, cols in (
        ("raw", ingest.raw(messages), ("value", "type", "source", "confidence")),
        ("rejected", ingest.rejected(rows), ("value", "type", "source", "reason")),
        ("indicators", ingest.indicators(rows), ("value", "type", "source", "confidence")),
        ("metadata", ingest.sightings(rows, ingest.indicators(rows)), ("source", "confidence")),
        ("timeline", ingest.discovered(messages), ("event_type", "event_value", "source")),
    ):
        assert key(stream.table(spark, base, name), *cols) == key(want, *cols), name
    in_order = lambda df, by, *c: [tuple(r) for r in df.orderBy(by).select(*c).collect()]
    own, want = stream.table(spark, base, "indicators"), ingest.indicators(rows)
    assert in_order(own, "id", "value", "type", "source", "confidence") == in_order(want, "id", "value", "type", "source", "confidence")
    assert in_order(stream.table(spark, base, "raw"), "seq", "value", "source") == in_order(messages, "seq", "value", "source")
    first = lambda sights, known: in_order(sights.join(known.select(F.col("id").alias("indicator_id"), "value", "type"), "indicator_id"), "seq", "value", "type", sights["source"])
    assert first(stream.table(spark, base, "metadata"), own) == first(ingest.sightings(rows, want), want)
    ids = own.select("id")
    assert ids.count() == ids.distinct().count()
    before = own.count()
    stream.apply_batch(queue.parse(spark.read.text(q)), 1, base)  # a batch that runs again replaces its part
    assert stream.table(spark, base, "indicators").count() == before


def test_first_in_first_out_over_files_of_any_size(spark, tmp_path):
    """One batch reads a small file and a larger one that came later: the first sighting still wins."""
    q, base = str(tmp_path / "q"), str(tmp_path / "out")
    queue.push(spark.createDataFrame([("8.8.8.8", "ip", "first", 10)], queue.MESSAGE), q)
    queue.push(spark.createDataFrame([(f"9.9.{i // 250}.{i % 250}", "ip", "x", 1) for i in range(3000)] + [("8.8.8.8", "ip", "second", 20)], queue.MESSAGE), q)
    stream.start(spark, q, base).awaitTermination()
    got = stream.table(spark, base, "indicators").orderBy("id").collect()
    assert (got[0].value, got[0].source, got[0].confidence, got[0].id) == ("8.8.8.8", "first", 10, 0)
    sights = stream.table(spark, base, "metadata").filter("indicator_id = 0").orderBy("seq").collect()
    assert [(r.source, r.confidence) for r in sights] == [("first", 10), ("second", 20)] and sights[1].seq == 3001


def test_foreign_records_come_in_order_of_their_files(spark, tmp_path):
    q = tmp_path / "q"
    q.mkdir()
    for i, name in enumerate(("z.txt", "a.txt", "m.txt")):
        (q / name).write_text("".join(json.dumps({"value": f"{name}{k}", "type": "md5"}) + "\n" for k in range(50)))
        os.utime(q / name, (1000 + i, 1000 + i))
    rows = queue.in_order(queue.pop_all(spark, str(q))).orderBy("seq").collect()
    assert [r.value for r in rows] == [f"{n}.txt{k}" for n in "zam" for k in range(50)]
    assert [r.seq for r in rows] == list(range(150)) and all(r["keys"] == ["value", "type"] for r in rows)


def test_numbers_are_unique_over_many_partitions_and_batches(spark, tmp_path):
    rows = spark.range(0, 3000, 1, 1500).select((3000 - F.col("id")).alias("k"))
    spark.conf.set("spark.sql.shuffle.partitions", "1500")
    try:
        got = ordering.numbered(rows, "k", first=7)
        assert got.agg(F.min("seq"), F.max("seq"), F.count_distinct("seq"), F.count_if(F.col("seq") != F.col("k") + 6)).first() == (7, 3006, 3000, 0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    base = str(tmp_path / "out")
    one = spark.createDataFrame([("8.8.8.8", "ip", "s", 5, "{}", ["source", "confidence"])], "value string, type string, source string, confidence int, raw_payload string, keys array<string>")
    for batch in (2**21 - 1, 2**21, 2**27 - 1):
        stream.guarded_batch(one, batch, base)
    assert stream.table(spark, base, "indicators").first().id == (2**21 - 1) << 36
    assert [r.seq for r in stream.table(spark, base, "metadata").orderBy("seq").collect()] == [b << 36 for b in (2**21 - 1, 2**21, 2**27 - 1)]
    assert stream.table(spark, base, "quarantine").count() == 0
    with pytest.raises(OverflowError):
        ordering.batch_first(2**27)
    assert ordering.numbered(rows.limit(0), "k").count() == 0


def test_one_bad_message_of_a_thousand(spark, tmp_path, monkeypatch):
    """The batch is halved until the bad message alone is set aside; the quarantine goes through again once the fault is gone."""
    q, base = str(tmp_path / "q"), str(tmp_path / "out")
    real = ingest.judged
    broken = lambda m: real(m).withColumn("reason", F.when(F.col("value") == "v617.com", F.raise_error(F.lit("bad message")).cast("string")).otherwise(F.col("reason")))
    monkeypatch.setattr(ingest, "judged", broken)
    queue.push(spark.createDataFrame([(f"v{i}.com", "domain", "s", 5) for i in range(1000)], queue.MESSAGE), q)
    stream.start(spark, q, base).awaitTermination()
    assert [r.value for r in stream.table(spark, base, "quarantine").collect()] == ["v617.com"]
    assert "bad message" in stream.table(spark, base, "quarantine").first().error
    for name in ("raw", "timeline", "indicators", "metadata"):
        assert stream.table(spark, base, name).count() == 999
    monkeypatch.setattr(ingest, "judged", real)
    assert stream.redrive(spark, base, q) == 1
    stream.start(spark, q, base).awaitTermination()
    for name in ("raw", "timeline", "indicators", "metadata"):
        assert stream.table(spark, base, name).count() == 1000
    assert stream.table(spark, base, "quarantine").count() == stream.redrive(spark, base, q) == 0


def test_a_batch_reads_the_buckets_of_its_keys(spark, tmp_path):
    base = str(tmp_path / "out")
    messages = lambda *v: spark.createDataFrame([(x, "md5", "s", i, "{}", ["source", "confidence"]) for i, x in enumerate(v)], "value string, type string, source string, confidence int, raw_payload string, keys array<string>")
    for batch in range(6):
        stream.apply_batch(messages(*[f"b{batch}v{i}" for i in range(20)], "always"), batch, base)
    own = messages("always", "b3v7").select(stream.bucket().alias("b")).distinct()
    buckets = [r.b for r in own.collect()]
    files = stream.known(spark, base, buckets, 6).inputFiles()
    assert len(buckets) == 2 and {f.split("bucket=")[1].split("/")[0] for f in files} == set(map(str, buckets))
    assert len(files) < 9 < len(stream.table(spark, base, "indicators").inputFiles())
    everything = lambda: sorted((r.id, r.value) for r in stream.table(spark, base, "indicators").collect())
    before = everything()
    assert len(before) == 121 and stream.compact(spark, base, before=6, parts=1) > 0
    assert everything() == before
    stream.apply_batch(messages("always", "new"), 6, base)
    assert len(everything()) == 122 and stream.table(spark, base, "metadata").filter(F.col("indicator_id") == dict((v, i) for i, v in before)["always"]).count() == 7


def test_shared_folder_does_not_grow(spark, tmp_path):
    folder = checkpoint_folder(spark)
    queue.push(spark.createDataFrame([("a.com", "domain", "s", 5)], queue.MESSAGE), str(tmp_path / "q"))
    stream.start(spark, str(tmp_path / "q"), str(tmp_path / "out")).awaitTermination()
    before = children(spark, folder)
    for i in range(3):
        queue.push(spark.createDataFrame([(f"{i}.com", "domain", "s", 5)], queue.MESSAGE), str(tmp_path / "q"))
        stream.start(spark, str(tmp_path / "q"), str(tmp_path / "out")).awaitTermination()
    assert children(spark, folder) == before


def test_guarded_consumer(spark, tmp_path):
    q, base = str(tmp_path / "q"), str(tmp_path / "out")
    queue.push(spark.createDataFrame([('{"data": 1}', "md5", "s", 5), ("ok", "md5", "s", 5)], queue.MESSAGE), q)
    stream.start(spark, q, base, guard=True, raw=False).awaitTermination()
    assert [r.value for r in stream.table(spark, base, "indicators").collect()] == ["ok"]
    assert stream.table(spark, base, "raw").count() == 0


def test_a_failing_batch_is_set_aside(spark, tmp_path, monkeypatch):
    """The batch leaves nothing but its messages in quarantine; the next batch is ingested."""
    q, base = str(tmp_path / "q"), str(tmp_path / "out")
    real, calls = ingest.sightings, []

    def fails_once(*a):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("first")
        return real(*a)

    monkeypatch.setattr(ingest, "sightings", fails_once)
    for value in ("one.com", "two.com"):
        queue.push(spark.createDataFrame([(value, "domain", "s", 5)], queue.MESSAGE), q)
        stream.start(spark, q, base).awaitTermination()
    assert [(r.value, r.error) for r in stream.table(spark, base, "quarantine").collect()] == [("one.com", "first")]
    for name in ("raw", "timeline", "indicators", "metadata"):
        assert stream.table(spark, base, name).count() == 1
    assert stream.table(spark, base, "indicators").first().value == "two.com"


def test_windows_close_with_the_watermark(spark, tmp_path):
    """An event that is late, but within the watermark, counts; a window is written once; one behind the watermark changes nothing."""
    def put(name, *rows):
        spark.createDataFrame([(f"2024-01-01 {t}", k) for t, k in rows], "at string, kind string").select(F.col("at").cast("timestamp").alias("at"), "kind").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        rows = spark.readStream.schema("at timestamp, kind string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        windows.start(rows, str(tmp_path / "out")).awaitTermination()
        return {(r.window_start.hour, r.kind): (r.n, r.first_at.minute, r.last_at.minute) for r in windows.table(spark, str(tmp_path / "out")).collect()}

    put("a", ("00:10:00", "x"), ("00:50:00", "x"), ("01:30:00", "y"))
    assert run() == {}
    put("b", ("00:20:00", "y"), ("02:45:00", "x"), ("00:05:00", "x"))  # late, but 00:45 is all that the watermark reaches then
    assert run() == {}
    put("c", ("05:00:00", "x"))
    want = {(0, "x"): (3, 5, 50), (0, "y"): (1, 20, 20), (1, "y"): (1, 30, 30), (2, "x"): (1, 45, 45)}
    assert run() == want
    put("d", ("00:30:00", "x"), ("05:30:00", "x"))
    assert run() == want
