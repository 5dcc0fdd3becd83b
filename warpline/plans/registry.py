"""Named queries over the generic test tables, and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warpline.functions import columns as C
from warpline.operators import campaigns, cluster, components, enrich, evidence, graph, ingest, lifecycle, lookup, relations, trigrams
from warpline.plans import fixtures as X
from warpline.session import shared_folder
from warpline.sources import feeds, queue
from warpline.streaming import ingest as stream
from warpline.streaming import windows
from warpline.streaming.graph_store import GraphStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# SQL building blocks -------------------------------------------------------------------------------

_DOMAIN_OK = r"(NOT contains(value, '..') AND NOT starts_with(value, '-') AND regexp_full_match(value, '(?:[a-z0-9-]{1,63}\.)+[a-z]{2,}'))"
_IP_OK = f"regexp_full_match(value, '{C.IPV4}')"
_SCHEME, _NETLOC, _PATH = (f"regexp_extract(trim(value), '{C.URI}', {i})" for i in (1, 2, 3))
_URL_OK = f"(regexp_extract(value, '{C.URI}', 1) <> '' AND regexp_extract(value, '{C.URI}', 2) <> '')"
_HASH_OK = "(length(value) IN (32, 40, 64))"
_VALID = f"CASE lower(type) WHEN 'domain' THEN {_DOMAIN_OK} WHEN 'ip' THEN {_IP_OK} WHEN 'url' THEN {_URL_OK} WHEN 'hash' THEN {_HASH_OK} ELSE true END"
_N_DOMAIN = f"regexp_replace(CASE WHEN starts_with(lower(trim(value)), 'http://') OR starts_with(lower(trim(value)), 'https://') THEN regexp_extract(lower(trim(value)), '{C.URI}', 2) ELSE lower(trim(value)) END, '^www\\.', '')"
_N_URL = f"lower({_SCHEME}) || '://' || lower({_NETLOC}) || rtrim(regexp_replace({_PATH}, ';[^/]*$', ''), '/')"
_NORMAL = f"CASE lower(type) WHEN 'domain' THEN {_N_DOMAIN} WHEN 'ip' THEN trim(value) WHEN 'url' THEN {_N_URL} WHEN 'hash' THEN lower(trim(value)) ELSE value END"
_JUDGED = f"""{X.IOC}, judged AS (SELECT *, {_VALID} AS ok, {_NORMAL} AS nvalue FROM ioc WHERE length(value) BETWEEN 1 AND 2000 AND confidence BETWEEN 0 AND 100)"""
_IND = f"""{_JUDGED}, ind AS (SELECT min(seq) AS id, nvalue AS value, type, arg_min(source, seq) AS source, arg_min(confidence, seq) AS confidence FROM judged WHERE ok GROUP BY nvalue, type)"""
_HOST = f"lower(coalesce(nullif(regexp_extract(value, '{C.URI}', 2), ''), value))"
_HOSTING = "CASE " + " ".join(f"WHEN ends_with(domain, '{s}') THEN '{p}'" for s, p in C.HOSTING) + " END"
_ENR = f"""{_IND}, {X.REFERENCES},
based AS (SELECT id, value, type, CASE type WHEN 'domain' THEN lower(value) WHEN 'url' THEN {_HOST} END AS domain FROM ind),
named AS (SELECT b.*, c.ns, c.ips, c.first_ip, w.registrar FROM based b LEFT JOIN clean c ON b.domain = c.domain LEFT JOIN who w ON b.domain = w.domain),
enr AS (SELECT n.id AS indicator_id, a.asn, n.registrar, coalesce({_HOSTING}, a.provider) AS hosting_provider, n.ns AS nameservers, n.ips AS resolved_ips, n.value, n.type
  FROM named n LEFT JOIN asn1 a ON a.ip = CASE WHEN n.type = 'ip' THEN n.value ELSE n.first_ip END)"""
_LABEL = "CASE lower(type) WHEN 'domain' THEN 'Domain' WHEN 'ip' THEN 'IP' WHEN 'url' THEN 'URL' WHEN 'hash' THEN 'Hash' ELSE 'Indicator' END"
_EDGES = f"""{_ENR},
dom AS (SELECT *, CASE lower(type) WHEN 'domain' THEN value WHEN 'url' THEN nullif(lower(regexp_extract(value, '{C.URI}', 2)), '') END AS domain FROM enr),
edges AS (SELECT DISTINCT * FROM (
SELECT 'Indicator' AS src_label, value AS src_value, 'INDICATES' AS rel, {_LABEL} AS dst_label, value AS dst_value FROM ind
UNION ALL SELECT 'URL', value, 'HOSTS', 'Domain', domain FROM dom WHERE lower(type) = 'url' AND domain IS NOT NULL
UNION ALL SELECT 'Domain', domain, 'RESOLVES_TO_ASN', 'ASN', asn FROM dom WHERE domain IS NOT NULL AND asn IS NOT NULL
UNION ALL SELECT 'Domain', domain, 'HOSTED_BY', 'HostingProvider', hosting_provider FROM dom WHERE domain IS NOT NULL AND hosting_provider IS NOT NULL
UNION ALL SELECT 'Domain', domain, 'REGISTERED_WITH', 'Registrar', registrar FROM dom WHERE domain IS NOT NULL AND registrar IS NOT NULL
UNION ALL SELECT 'Domain', domain, 'USES_NS', 'Nameserver', unnest(string_split(nameservers, ',')) FROM dom WHERE domain IS NOT NULL
UNION ALL SELECT 'Domain', domain, 'RESOLVES_TO_IP', 'IP', unnest(string_split(resolved_ips, ',')) FROM dom WHERE domain IS NOT NULL))"""
_REACH = f"""WITH RECURSIVE {_EDGES}, both_ AS (SELECT src_label AS al, src_value AS a, dst_label AS bl, dst_value AS b FROM edges UNION SELECT dst_label, dst_value, src_label, src_value FROM edges),
walk(sl, s, l, v, d) AS (SELECT DISTINCT al, a, al, a, 0 FROM both_ WHERE al IN ('URL', 'Domain', 'IP', 'Hash')
  UNION SELECT w.sl, w.s, e.bl, e.b, w.d + 1 FROM walk w JOIN both_ e ON w.l = e.al AND w.v = e.a WHERE w.d < 4),
reached AS (SELECT DISTINCT sl, s, l, v FROM walk WHERE l IN ('URL', 'Domain', 'IP', 'Hash'))"""
_CLUSTERS = f"""{_REACH}, sets AS (SELECT DISTINCT array_to_string(list_sort(list_distinct(list(v))), '|') AS cluster, len(list_distinct(list(v))) AS n FROM reached GROUP BY sl, s), big AS (SELECT * FROM sets WHERE n > 1)"""
_FP = f"""{X.HOSTS}, fps AS (SELECT indicator_id AS pos, value, list_sort(list_distinct(list_concat(['asn:' || asn, 'registrar:' || registrar],
  CASE WHEN hosting_provider IS NULL THEN CAST([] AS VARCHAR[]) ELSE ['hosting:' || hosting_provider] END, list_transform(string_split(nameservers, ','), lambda x: 'ns:' || x)))) AS fp FROM hosts),
pairs AS (SELECT a.pos AS a, b.pos AS b, a.value AS av, b.value AS bv, len(list_intersect(a.fp, b.fp)) AS k, len(a.fp) AS na, len(b.fp) AS nb
  FROM fps a JOIN fps b ON a.pos < b.pos WHERE 7 * len(list_intersect(a.fp, b.fp)) >= 3 * (len(a.fp) + len(b.fp)))"""
_LEAD = f"""WITH RECURSIVE {_FP}, numbered AS (SELECT pos, row_number() OVER (ORDER BY pos) AS i FROM fps),
nb AS (SELECT n.i, n.pos, coalesce(list(p.a) FILTER (p.a IS NOT NULL), CAST([] AS BIGINT[])) AS earlier FROM numbered n LEFT JOIN pairs p ON p.b = n.pos GROUP BY n.i, n.pos),
step(i, leaders) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT nb.i, CASE WHEN list_has_any(step.leaders, nb.earlier) THEN step.leaders ELSE list_append(step.leaders, nb.pos) END FROM step JOIN nb ON nb.i = step.i + 1),
lead AS (SELECT unnest(leaders) AS leader FROM (SELECT leaders FROM step ORDER BY i DESC LIMIT 1)),
members AS (SELECT leader, leader AS member_pos, value AS member FROM lead JOIN fps ON pos = leader
  UNION ALL SELECT leader, b, bv FROM lead JOIN pairs ON a = leader),
clus AS (SELECT leader, list(member ORDER BY member_pos) AS indicators FROM members GROUP BY leader HAVING count(*) > 1),
camp AS (SELECT 'campaign_' || (concat('0x', substr(sha256(array_to_string(list_sort(indicators), '|')), 1, 15))::BIGINT % 10000000000) AS campaign_id, indicators, len(indicators) AS size FROM clus)"""
_KIND = "CASE WHEN starts_with(x, 'http') THEN 'url' WHEN contains(x, '.') THEN 'domain' ELSE 'hash' END"
_SCORE = f"least(CASE WHEN size >= 10 THEN 40 WHEN size >= 5 THEN 25 WHEN size >= 3 THEN 15 ELSE 5 END + 10 * len(list_distinct(list_transform(indicators, lambda x: {_KIND}))), 100)"
_SCORED = f"{_LEAD}, scored AS (SELECT *, {_SCORE} AS confidence FROM camp)"
_STRENGTH = "CASE WHEN confidence >= 80 THEN 'high' WHEN confidence >= 50 THEN 'medium' ELSE 'low' END"


def _tech(pairs: tuple[tuple[str, str], ...], value: str = "value") -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN contains({value}, '{k}') THEN '{t}' END" for k, t in pairs) + ")"


# helpers -------------------------------------------------------------------------------------------


def _judged(s: SparkSession, d: str) -> DataFrame:
    return ingest.judged(X.ioc(s, d))


def _indicators(s: SparkSession, d: str) -> DataFrame:
    return ingest.indicators(_judged(s, d))


def _enriched(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ind = graph.checkpointed(_indicators(s, d))
    return ind, enrich.enrich(ind, *X.references(s, d))


def _of(s: SparkSession, d: str, kind: str) -> DataFrame:
    return X.ioc(s, d).filter(F.lower("type") == kind)


def _sorted_list(c: str):  # noqa: ANN202
    return F.array_join(F.array_sort(F.split(c, ",")), ",")


def _ind_sql(select: str) -> str:
    return f"WITH {_IND} {select}"


# validation and normalisation ----------------------------------------------------------------------


@query(f"WITH {X.IOC} SELECT seq, value, {_DOMAIN_OK} AS ok FROM ioc WHERE lower(type) = 'domain'")
def val_domain(s, d):
    return _of(s, d, "domain").select("seq", "value", C.valid_domain(F.col("value")).alias("ok"))


@query(f"WITH {X.IOC} SELECT seq, value, {_IP_OK} AS ok FROM ioc WHERE lower(type) = 'ip'")
def val_ip(s, d):
    return _of(s, d, "ip").select("seq", "value", C.valid_ip(F.col("value")).alias("ok"))


@query(f"WITH {X.IOC} SELECT seq, value, {_URL_OK} AS ok FROM ioc WHERE lower(type) = 'url'")
def val_url(s, d):
    return _of(s, d, "url").select("seq", "value", C.valid_url(F.col("value")).alias("ok"))


@query(f"WITH {X.IOC} SELECT seq, value, {_HASH_OK} AS ok FROM ioc WHERE lower(type) = 'hash'")
def val_hash(s, d):
    return _of(s, d, "hash").select("seq", "value", C.valid_hash(F.col("value")).alias("ok"))


@query(f"WITH {X.IOC} SELECT type, {_VALID} AS ok, count(*) AS n FROM ioc GROUP BY ALL")
def val_dispatch(s, d):
    return X.ioc(s, d).groupBy("type", C.valid(F.col("value"), F.col("type")).alias("ok")).agg(F.count("*").alias("n"))


@query(f"WITH {_JUDGED} SELECT seq, value, type, source, 'invalid ' || lower(type) AS reason FROM judged WHERE NOT ok")
def reject_reasons(s, d):
    return ingest.rejected(_judged(s, d))


@query(f"WITH {X.IOC} SELECT seq, {_N_DOMAIN} AS nvalue FROM ioc WHERE lower(type) = 'domain'")
def nrm_domain(s, d):
    return _of(s, d, "domain").select("seq", C.normal_domain(F.col("value")).alias("nvalue"))


@query(f"WITH {X.IOC} SELECT seq, {_N_URL} AS nvalue FROM ioc WHERE lower(type) = 'url'")
def nrm_url(s, d):
    return _of(s, d, "url").select("seq", C.normal_url(F.col("value")).alias("nvalue"))


@query(f"WITH {X.IOC} SELECT seq, lower(trim(value)) AS nvalue FROM ioc WHERE lower(type) = 'hash'")
def nrm_hash(s, d):
    return _of(s, d, "hash").select("seq", C.normal_hash(F.col("value")).alias("nvalue"))


@query(f"WITH {X.IOC} SELECT seq, trim(value) AS nvalue FROM ioc WHERE lower(type) = 'ip'")
def nrm_ip(s, d):
    return _of(s, d, "ip").select("seq", C.normal_ip(F.col("value")).alias("nvalue"))


@query(f"WITH {X.IOC} SELECT seq, type, {_NORMAL} AS nvalue FROM ioc")
def nrm_dispatch(s, d):
    return X.ioc(s, d).select("seq", "type", C.normal(F.col("value"), F.col("type")).alias("nvalue"))


# ingestion -----------------------------------------------------------------------------------------


@query(f"""WITH {X.IOC} SELECT seq, value FROM ioc WHERE length(value) <= 2000
AND NOT (starts_with(trim(value), '{{') AND coalesce(list_has_any(json_keys(CASE WHEN json_valid(value) THEN value END), ['results', 'data']), false))""")
def guard_payload(s, d):
    return ingest.guard(X.ioc(s, d)).select("seq", "value")


@query(f"WITH {X.IOC} SELECT seq, length(value) BETWEEN 1 AND 2000 AND confidence BETWEEN 0 AND 100 AS ok FROM ioc")
def schema_check(s, d):
    return X.ioc(s, d).select("seq", ingest.schema_ok().alias("ok"))


@query(_ind_sql("SELECT id, value, type, source, confidence FROM ind"))
def dedupe_first_wins(s, d):
    return _indicators(s, d)


@query(_ind_sql("SELECT seq, id AS indicator_id, j.source, j.confidence FROM judged j JOIN ind ON j.nvalue = ind.value AND j.type = ind.type WHERE ok"))
def metadata_sightings(s, d):
    rows = _judged(s, d)
    return ingest.sightings(rows, ingest.indicators(rows))


@query(f"WITH {X.IOC} SELECT seq, value, type, source, confidence FROM ioc")
def raw_store(s, d):
    return ingest.raw(X.ioc(s, d)).select("seq", "value", "type", "source", "confidence")


@query(f"WITH {X.IOC} SELECT seq, 'indicator_discovered' AS event_type, value AS event_value, source FROM ioc")
def discovered_events(s, d):
    return ingest.discovered(X.ioc(s, d))


@query(_ind_sql("SELECT id FROM ind WHERE value = '8.8.8.8' AND type = 'ip'"))
def find_duplicate(s, d):
    return ingest.find_duplicate(_indicators(s, d), "8.8.8.8", "ip").select("id")


# feeds and queue -----------------------------------------------------------------------------------


def _registry(s: SparkSession, d: str) -> feeds.Registry:
    """Feeds whose bodies are made from pages and parts."""
    pages = X.read(s, d, "pages").select("page_id", "url")
    urls = pages.select(F.concat(F.lit("\n "), F.col("url"), F.lit(" \n\n")).alias("value"))
    domains = pages.select(C.netloc(F.col("url")).alias("value"))
    pair = F.concat(F.lit('{"ioc": "'), F.col("url"), F.when(F.col("page_id") % 2 == 0, F.lit('", "ioc_type": "url"}')).otherwise(F.lit('"}')))
    fox = pages.select(F.concat(F.lit('{"data": ['), pair, F.lit(', {"ioc": ""}]}')).alias("value"))
    bazaar = pages.select(F.concat(F.lit('{"data": [{"sha256_hash": "'), F.sha2("url", 256), F.lit('"}, {"sha256_hash": null}]}')).alias("value"))
    r = feeds.Registry()
    for name, body, parse in (("openphish", urls, feeds.openphish), ("otx", domains, feeds.otx), ("threatfox", fox, feeds.threatfox), ("malwarebazaar", bazaar, feeds.malwarebazaar)):
        r.register(feeds.Feed(name, lambda _, b=body: b, parse))
    return r


_FEEDS = f"""p AS (SELECT page_id, url, regexp_extract(url, '{C.URI}', 2) AS host FROM pages WHERE url IS NOT NULL),
feed AS (SELECT 0 AS feed_ord, url AS value, 'url' AS type, 'openphish' AS source, 80 AS confidence FROM p
UNION ALL SELECT 1, host, 'domain', 'otx', 70 FROM p WHERE host <> ''
UNION ALL SELECT 2, url, CASE WHEN page_id % 2 = 0 THEN 'url' ELSE 'domain' END, 'threatfox', 75 FROM p
UNION ALL SELECT 3, sha256(url), 'hash', 'malwarebazaar', 85 FROM p)"""


@query(f"WITH {_FEEDS} SELECT * FROM feed")
def feed_union(s, d):
    return _registry(s, d).run(s).drop("pos")


@query(f"WITH {_FEEDS} SELECT value, type FROM feed WHERE feed_ord < 2")
def feed_text_parse(s, d):
    return _registry(s, d).run(s).filter("feed_ord < 2").select("value", "type")


@query(f"WITH {_FEEDS} SELECT value, type FROM feed WHERE feed_ord >= 2")
def feed_json_parse(s, d):
    return _registry(s, d).run(s).filter("feed_ord >= 2").select("value", "type")


@query(f"WITH {_FEEDS} SELECT source, count(*) AS n FROM feed GROUP BY source")
def feed_counts(s, d):
    return _registry(s, d).run(s).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT p_name AS value, CAST(p_partkey AS INT) AS pos FROM part ORDER BY p_partkey LIMIT 10")
def feed_sample10(s, d):
    rows = X.read(s, d, "part").select(F.col("p_name").alias("value"), F.lit(0).alias("feed_ord"), F.col("p_partkey").cast("int").alias("pos"))
    return feeds.sample(rows).select("value", "pos")


@query("SELECT event_type AS name, CAST(arg_max(user_id, event_id) AS BIGINT) AS indicators_collected, CASE WHEN arg_max(value, event_id) > 10 THEN 'success' ELSE 'failed' END AS status FROM events GROUP BY event_type UNION ALL SELECT 'old', 7, 'success'")
def feed_status_upsert(s, d):
    runs = X.read(s, d, "events").select(F.col("event_type").alias("name"), F.col("user_id").alias("count"), F.coalesce(F.col("value") > 10, F.lit(False)).alias("success"), F.col("event_id").alias("seq"))
    stored = s.createDataFrame([("old", 7, "success"), ("click", 1, "failed")], "name string, indicators_collected long, status string")
    return campaigns.feed_status(runs, stored)


_STATUS_SQL = "SELECT event_type AS name, CAST(arg_max(user_id, event_id) AS BIGINT) AS indicators_collected, CASE WHEN arg_max(value, event_id) > 10 THEN 'success' ELSE 'failed' END AS status FROM events WHERE event_type = 'click' GROUP BY event_type"


@query(_STATUS_SQL)
def feed_by_name(s, d):
    return lookup.feed_by_name(feed_status_upsert(s, d), "click")


@query(f"WITH {X.IOC} SELECT count(*) AS depth FROM ioc")
def queue_backlog(s, d):
    """Messages pushed to a queue folder and counted there."""
    path = shared_folder(s)
    queue.push(X.ioc(s, d), path)
    return queue.depth(s, path)


@query(f"WITH {X.IOC} SELECT count(*) AS depth FROM ioc")
def queue_depth(s, d):
    messages = X.ioc(s, d).select(F.to_json(F.struct("value", "type", "source", "confidence")).alias("value"))
    return queue.parse(messages).agg(F.count("*").alias("depth"))


@query("SELECT 1 AS ok")
def health(s, d):
    return lookup.health(s)


# look-ups ------------------------------------------------------------------------------------------


@query(_ind_sql("SELECT id, value, type, source, confidence FROM ind"))
def indicator_list(s, d):
    return lookup.indicator_list(_indicators(s, d))


@query(_ind_sql(f"SELECT id, value, type, source, confidence FROM ind WHERE id = {6 * 10**13}"))
def indicator_by_id(s, d):
    return lookup.indicator(_indicators(s, d), 6 * 10**13)


@query(_ind_sql("SELECT id, value, type, source, confidence FROM ind WHERE value LIKE '%example.n_t%'"))
def pivot_domain(s, d):
    return lookup.pivot_domain(_indicators(s, d), "example.n_t")


@query(_ind_sql("SELECT id, value, type, source, confidence FROM ind WHERE value = '8.8.8.8'"))
def pivot_ip(s, d):
    return lookup.pivot_ip(_indicators(s, d), "8.8.8.8")


@query("SELECT event_id AS id, event_type, ts AS created_at FROM events WHERE user_id = 3")
def campaign_timeline(s, d):
    rows = X.read(s, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("campaign_id"), "event_type", F.col("ts").alias("created_at"))
    return lookup.timeline(rows, "user_3").select("id", "event_type", "created_at")


# enrichment ----------------------------------------------------------------------------------------


@query(_ind_sql(f"SELECT id, {_HOST} AS host FROM ind WHERE type = 'url'"))
def host_extract(s, d):
    return _indicators(s, d).filter("type = 'url'").select("id", C.url_host(F.col("value")).alias("host"))


@query(_ind_sql(f"SELECT value AS domain, {_HOSTING.replace('domain', 'value')} AS platform FROM ind WHERE type = 'domain'"))
def hosting_suffix(s, d):
    return _indicators(s, d).filter("type = 'domain'").select(F.col("value").alias("domain"), C.hosting(F.col("value")).alias("platform"))


@query("""SELECT p_partkey, nullif(array_to_string(list_filter([lower(trim(p_type)), CASE WHEN lower(p_brand) <> lower(trim(p_type)) THEN lower(p_brand) END], lambda x: x IS NOT NULL), ','), '') AS cleaned FROM part""")
def list_clean(s, d):
    a = F.array(F.concat(F.lit("  "), F.col("p_type"), F.lit(" ")), F.upper("p_type"), F.lit(None).cast("string"), F.lit(" "), F.col("p_brand"))
    return X.read(s, d, "part").select("p_partkey", C.clean_list(a).alias("cleaned"))


@query("SELECT p_partkey, nullif(regexp_extract(p_name, '^\\s*(\\S+)', 1), '') AS asn FROM part")
def asn_token(s, d):
    return X.read(s, d, "part").select("p_partkey", C.asn_token(F.col("p_name")).alias("asn"))


_ENR_COLS = "indicator_id, asn, registrar, hosting_provider, nameservers, resolved_ips"


def _enr_rows(s: SparkSession, d: str, where: str) -> DataFrame:
    ind, e = _enriched(s, d)
    rows = e.join(ind.select(F.col("id").alias("indicator_id"), "type"), "indicator_id").filter(where)
    return rows.select("indicator_id", "asn", "registrar", "hosting_provider", _sorted_list("nameservers").alias("nameservers"), "resolved_ips")


@query(f"WITH {_ENR} SELECT {_ENR_COLS} FROM enr WHERE type = 'ip'")
def enrich_ip(s, d):
    return _enr_rows(s, d, "type = 'ip'")


@query(f"WITH {_ENR} SELECT {_ENR_COLS} FROM enr WHERE type = 'domain'")
def enrich_domain(s, d):
    return _enr_rows(s, d, "type = 'domain'")


@query(f"WITH {_ENR} SELECT {_ENR_COLS} FROM enr")
def enrich_all(s, d):
    return _enr_rows(s, d, "true")


@query(_ind_sql("SELECT id FROM ind WHERE id % 3 <> 0"))
def enrich_pending(s, d):
    ind = graph.checkpointed(_indicators(s, d))
    return enrich.pending(ind, ind.filter("id % 3 = 0").select(F.col("id").alias("indicator_id"))).select("id")


@query(f"WITH {_ENR} SELECT 'infrastructure_enriched' AS event_type, value AS event_value, 'enrichment_worker' AS source FROM enr")
def enrich_events(s, d):
    ind, e = _enriched(s, d)
    return enrich.events(e, ind)


# graph ---------------------------------------------------------------------------------------------


def _edges(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ind, e = _enriched(s, d)
    return ind, graph.checkpointed(graph.edges(ind, e))


@query(f"WITH {_EDGES} SELECT * FROM edges")
def graph_edges(s, d):
    return _edges(s, d)[1]


@query(f"""WITH {_EDGES}, ends AS (SELECT DISTINCT src_label AS label, src_value AS value FROM edges UNION SELECT dst_label, dst_value FROM edges),
own AS (SELECT {_LABEL} AS label, value, arg_max(type, id) AS type, arg_max(source, id) AS source, arg_max(confidence, id) AS confidence FROM ind GROUP BY 1, 2)
SELECT ends.label, ends.value, type, source, confidence FROM ends LEFT JOIN own ON ends.label = own.label AND ends.value = own.value""")
def graph_nodes(s, d):
    return graph.nodes(*_edges(s, d))


@query(f"WITH {_EDGES}, ends AS (SELECT src_label AS label, src_value AS value FROM edges UNION ALL SELECT dst_label, dst_value FROM edges) SELECT label, value, count(*) AS degree FROM ends GROUP BY ALL")
def graph_degree(s, d):
    return graph.degrees(_edges(s, d)[1])


@query(f"{_REACH} SELECT s AS start, v AS node FROM reached WHERE NOT (sl = l AND s = v)")
def graph_reach4(s, d):
    return graph.reach_values(_edges(s, d)[1])


@query(f"{_CLUSTERS} SELECT cluster FROM big")
def graph_clusters(s, d):
    return graph.clusters(_edges(s, d)[1]).select(F.array_join("cluster", "|").alias("cluster"))


@query(f"{_CLUSTERS} SELECT 'candidate_' || substr(sha256(cluster), 1, 12) AS campaign_id, cluster AS indicators, CAST(n AS INT) AS size FROM big")
def graph_candidates(s, d):
    return graph.candidates(graph.clusters(_edges(s, d)[1])).select("campaign_id", F.array_join("indicators", "|").alias("indicators"), "size")


# fingerprints, clusters, campaigns -----------------------------------------------------------------


def _values(s: SparkSession, d: str) -> DataFrame:
    h = X.hosts(s, d)
    return cluster.fingerprint(h.withColumn("pos", F.col("indicator_id")), "pos", "value")


def _found(s: SparkSession, d: str) -> DataFrame:
    return graph.checkpointed(campaigns.identified(cluster.as_arrays(cluster.clusters(_values(s, d)))))


@query(f"WITH {_FP} SELECT value, array_to_string(fp, '|') AS fp FROM fps")
def fingerprints(s, d):
    return _values(s, d).select("value", F.array_join("fp", "|").alias("fp"))


@query(f"""WITH {_ENR}, tagged AS (SELECT value, indicator_id, list_sort(list_distinct(list_concat(list_filter(['asn:' || asn, 'registrar:' || registrar, 'hosting:' || hosting_provider], lambda x: x IS NOT NULL),
  list_transform(coalesce(string_split(nameservers, ','), CAST([] AS VARCHAR[])), lambda x: 'ns:' || x)))) AS fp FROM enr)
SELECT value, min(indicator_id) AS pos, array_to_string(arg_max(fp, indicator_id), '|') AS fp FROM tagged GROUP BY value""")
def fingerprint_by_value(s, d):
    ind, e = _enriched(s, d)
    return cluster.by_value(e, ind).select("value", "pos", F.array_join("fp", "|").alias("fp"))


@query(f"""WITH {_FP}, d AS (SELECT fp, min(pos) AS pos FROM fps GROUP BY fp) SELECT a.pos AS a, b.pos AS b FROM d a JOIN d b ON a.pos < b.pos WHERE 7 * len(list_intersect(a.fp, b.fp)) >= 3 * (len(a.fp) + len(b.fp))""")
def jaccard_pairs(s, d):
    return cluster.adjacent(graph.checkpointed(_values(s, d).groupBy("fp").agg(F.min("pos").alias("pos"))))


@query(f"{_LEAD} SELECT leader, member_pos, member FROM members WHERE leader IN (SELECT leader FROM clus)")
def leader_clusters(s, d):
    return cluster.clusters(_values(s, d))


@query(f"{_LEAD} SELECT campaign_id, array_to_string(indicators, '|') AS indicators, CAST(size AS INT) AS size FROM camp")
def campaign_ids(s, d):
    return _found(s, d).select("campaign_id", F.array_join("indicators", "|").alias("indicators"), "size")


@query(f"{_LEAD} SELECT campaign_id, CASE WHEN size % 2 = 0 THEN 'existing' ELSE 'new' END AS status FROM camp")
def campaign_new_vs_existing(s, d):
    found = _found(s, d)
    return campaigns.with_status(found, found.filter("size % 2 = 0")).select("campaign_id", "status")


@query(f"{_LEAD} SELECT DISTINCT campaign_id, 60 AS confidence, 'emerging' AS strength, CAST(size AS INT) AS indicator_count FROM camp WHERE size % 2 <> 0")
def campaign_list(s, d):
    found = _found(s, d)
    return lookup.campaign_list(campaigns.new_rows(found, found.filter("size % 2 = 0"))).drop("campaign_key")


@query(f"{_LEAD} SELECT DISTINCT campaign_id, 'campaign_created' AS event_type, campaign_id AS event_value, 'campaign_engine' AS source FROM camp")
def campaign_created_events(s, d):
    found = _found(s, d)
    return campaigns.created_events(campaigns.new_rows(found, found.filter("false")))


@query(f"{_LEAD} SELECT campaign_id, CAST(size AS INT) AS size FROM camp WHERE campaign_id = (SELECT min(campaign_id) FROM camp)")
def campaign_by_id(s, d):
    found = _found(s, d)
    return lookup.campaign(found, found.agg(F.min("campaign_id")).first()[0] or "").select("campaign_id", "size")


@query(f"{_LEAD} SELECT count(*) AS campaigns_created, CAST(sum(size) AS BIGINT) AS memberships FROM camp")
def campaign_run_summary(s, d):
    return _found(s, d).agg(F.count("*").alias("campaigns_created"), F.sum("size").alias("memberships"))


@query(f"{_SCORED} SELECT campaign_id, CAST(size AS INT) AS size, CAST(confidence AS INT) AS confidence, {_STRENGTH} AS strength FROM scored")
def score_campaigns(s, d):
    return campaigns.scored(_found(s, d)).select("campaign_id", "size", "confidence", "strength")


@query(f"{_SCORED} SELECT {_STRENGTH} AS strength, count(*) AS n FROM scored GROUP BY 1")
def strength_class(s, d):
    return campaigns.scored(_found(s, d)).groupBy("strength").agg(F.count("*").alias("n"))


@query(f"{_SCORED} SELECT campaign_id, CAST(confidence AS INT) AS confidence, {_STRENGTH} AS strength, CAST(size AS INT) AS indicator_count FROM scored")
def campaign_materialize(s, d):
    return campaigns.materialised(campaigns.scored(_found(s, d)))


@query(_ind_sql(f"SELECT id, {_tech(C.DOMAIN_KEYWORDS)} AS techniques FROM ind WHERE type = 'domain'"))
def technique_domain(s, d):
    return _indicators(s, d).filter("type = 'domain'").select("id", F.array_join(C.technique(F.col("value"), C.DOMAIN_KEYWORDS), "|").alias("techniques"))


@query(_ind_sql(f"SELECT id, {_tech(C.URL_KEYWORDS)} AS techniques FROM ind WHERE type = 'url'"))
def technique_url(s, d):
    return _indicators(s, d).filter("type = 'url'").select("id", F.array_join(C.technique(F.col("value"), C.URL_KEYWORDS), "|").alias("techniques"))


def _infrastructure(s: SparkSession, d: str) -> DataFrame:
    return _values(s, d).select(F.col("value").alias("member"), "fp")


def _attributed(s: SparkSession, d: str) -> DataFrame:
    """The campaigns with the registrar and network of most members, under names that actor profiles know."""
    rows = campaigns.with_infrastructure(_found(s, d), _infrastructure(s, d))
    r, a = F.col("registrar"), F.pmod(F.substring("asn", 3, 20).cast("long"), F.lit(4))
    return rows.withColumns({"registrar": F.when(r == "com", "Namecheap").when(r == "net", "GoDaddy").otherwise(r), "asn": F.when(a == 0, "AS13335").when(a == 1, "AS20940").otherwise(F.col("asn"))})


_MEM = f"""{_LEAD}, mem AS (SELECT DISTINCT campaign_id, unnest(indicators) AS member FROM camp),
feat AS (SELECT campaign_id, f, count(*) AS k FROM (SELECT campaign_id, unnest(fp) AS f FROM mem JOIN fps ON member = value) GROUP BY ALL)"""
_ACTORS = f"""{_MEM}, most AS (SELECT campaign_id, arg_min(substr(f, 11), struct_pack(a := -k, b := f)) FILTER (starts_with(f, 'registrar:')) AS r, arg_min(substr(f, 5), struct_pack(a := -k, b := f)) FILTER (starts_with(f, 'asn:')) AS a FROM feat GROUP BY campaign_id),
base AS (SELECT campaign_id, indicators[1] AS one, r = 'com' AS com, r = 'net' AS net, CAST(substr(a, 3) AS BIGINT) % 4 AS m FROM camp LEFT JOIN most USING (campaign_id)),
scores AS (SELECT campaign_id, 'APT29' AS actor, 0 AS ord, round(CASE WHEN com THEN 0.3 ELSE 0 END + CASE WHEN m = 0 THEN 0.3 ELSE 0 END + CASE WHEN contains(one, 'login') THEN 0.2 ELSE 0 END, 6)::DOUBLE AS score FROM base
UNION ALL SELECT campaign_id, 'Lazarus', 1, round(CASE WHEN net THEN 0.3 ELSE 0 END + CASE WHEN m = 1 THEN 0.3 ELSE 0 END + CASE WHEN contains(one, 'update') THEN 0.2 ELSE 0 END, 6)::DOUBLE FROM base)"""


@query(f"{_ACTORS} SELECT campaign_id, actor, score FROM scores")
def actor_scores(s, d):
    return campaigns.actor_scores(_attributed(s, d)).select("campaign_id", "actor", "score")


@query(f"{_ACTORS} SELECT campaign_id, actor, score FROM scores QUALIFY row_number() OVER (PARTITION BY campaign_id ORDER BY score DESC, ord) = 1")
def attribution_best(s, d):
    return campaigns.attribution(campaigns.actor_scores(_attributed(s, d)))


def _signals(s: SparkSession, d: str) -> DataFrame:
    """Signals of the campaigns; a host is sighted on its pages, whose numbers stand for time."""
    at = X.read(s, d, "pages").filter("url is not null").select(C.netloc(F.col("url")).alias("member"), F.col("page_id").alias("at"))
    return evidence.signals(lifecycle.memberships(_found(s, d)), _infrastructure(s, d), at)


_SIGNALS = f"""{_MEM}, sz AS (SELECT campaign_id, count(*) AS n FROM mem GROUP BY campaign_id),
held AS (SELECT campaign_id, max(k) FILTER (starts_with(f, 'asn:')) AS a, max(k) FILTER (starts_with(f, 'ns:')) AS s, max(k) FILTER (starts_with(f, 'hosting:')) AS h FROM feat GROUP BY campaign_id),
seen AS (SELECT regexp_extract(url, '{C.URI}', 2) AS member, min(page_id) AS first, max(page_id) AS last FROM pages WHERE url IS NOT NULL GROUP BY 1),
span AS (SELECT * FROM mem JOIN seen USING (member)),
two AS (SELECT x.campaign_id, count(*) AS pairs, count(*) FILTER (x.first <= y.last AND y.first <= x.last) AS o FROM span x JOIN span y ON x.campaign_id = y.campaign_id AND x.member < y.member GROUP BY 1),
alike AS (SELECT x.campaign_id, count(DISTINCT lower(x.member)) AS k FROM mem x JOIN mem y ON x.campaign_id = y.campaign_id AND lower(x.member) <> lower(y.member) AND levenshtein(lower(x.member), lower(y.member)) <= 2 GROUP BY 1),
signals AS (SELECT campaign_id, coalesce(a >= 2 AND 2 * a >= n, false) AS shared_asn, coalesce(s >= 2 AND 2 * s >= n, false) AS shared_nameserver, coalesce(h >= 2 AND 2 * h >= n, false) AS shared_hosting,
  coalesce(pairs > 0 AND 2 * o >= pairs, false) AS temporal_overlap, coalesce(2 * k >= n, false) AS domain_similarity FROM sz LEFT JOIN held USING (campaign_id) LEFT JOIN two USING (campaign_id) LEFT JOIN alike USING (campaign_id))"""


@query(f"{_SIGNALS} SELECT * FROM signals")
def evidence_signals(s, d):
    return _signals(s, d)


@query(f"{_SIGNALS} SELECT campaign_id, round(0.25 * shared_asn::INT + 0.20 * shared_nameserver::INT + 0.15 * shared_hosting::INT + 0.10 * temporal_overlap::INT + 0.20 * domain_similarity::INT, 6)::DOUBLE AS evidence_score FROM signals")
def evidence_score(s, d):
    return campaigns.evidence(_signals(s, d)).select("campaign_id", "evidence_score")


@query(f"{_SIGNALS} SELECT campaign_id, count(*) AS pairs, count(*) FILTER (x.first <= y.last AND y.first <= x.last) AS overlapping FROM span x JOIN span y USING (campaign_id) WHERE x.member < y.member GROUP BY campaign_id")
def evidence_overlaps(s, d):
    at = X.read(s, d, "pages").filter("url is not null").groupBy(C.netloc(F.col("url")).alias("member")).agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    return evidence.overlaps(lifecycle.memberships(_found(s, d)).join(at, "member"), "campaign_id").select("campaign_id", "pairs", "overlapping")


@query(f"WITH {X.HOSTS} SELECT registrar, a.value AS a, b.value AS b FROM hosts a JOIN hosts b USING (registrar) WHERE a.value < b.value AND levenshtein(a.value, b.value) <= 2")
def similar_domains(s, d):
    """Names within two edits of one another under one registrar."""
    return evidence.similar(X.hosts(s, d).select("registrar", F.col("value").alias("text")), "registrar")


# lifecycle -----------------------------------------------------------------------------------------


def _half(s: SparkSession, d: str, first: bool) -> DataFrame:
    """Clusters of the hosts on the first or the second half of the pages."""
    middle = (X.read(s, d, "pages").agg(F.max("page_id")).first()[0] or 0) // 2
    h = X.hosts(s, d, F.col("page_id") <= middle if first else F.col("page_id") > middle)
    values = cluster.fingerprint(h.withColumn("pos", F.col("indicator_id")), "pos", "value")
    return campaigns.identified(cluster.as_arrays(cluster.clusters(values)))


def _half_sql(suffix: str, test: str) -> str:
    """The clusters' SQL over some pages, with names of its own."""
    text = _LEAD.removeprefix("WITH RECURSIVE ").replace("FROM pages WHERE url IS NOT NULL", f"FROM pages WHERE url IS NOT NULL AND page_id {test} (SELECT max(page_id) // 2 FROM pages)")
    names = ("host0", "host1", "hosts", "fps", "pairs", "numbered", "nb", "step", "lead", "members", "clus", "camp")
    return re.sub(rf"\b({'|'.join(names)})\b", lambda m: m[1] + suffix, text)


_LIFE = f"""WITH RECURSIVE {_half_sql("_a", "<=")}, {_half_sql("_b", ">")},
was AS (SELECT DISTINCT campaign_id AS p, unnest(indicators) AS member FROM camp_a), found AS (SELECT DISTINCT campaign_id AS q, unnest(indicators) AS member FROM camp_b),
edge AS (SELECT p, q, count(*) AS k FROM was JOIN found USING (member) GROUP BY ALL), listed AS (SELECT p, q, row_number() OVER (ORDER BY p = q DESC, k DESC, p, q) AS i FROM edge),
walk(i, ps, qs) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) UNION ALL
  SELECT e.i, CASE WHEN list_contains(w.ps, e.p) OR list_contains(w.qs, e.q) THEN w.ps ELSE list_append(w.ps, e.p) END, CASE WHEN list_contains(w.ps, e.p) OR list_contains(w.qs, e.q) THEN w.qs ELSE list_append(w.qs, e.q) END FROM walk w JOIN listed e ON e.i = w.i + 1),
matched AS (SELECT unnest(ps) AS p, unnest(qs) AS q FROM (SELECT ps, qs FROM walk ORDER BY i DESC LIMIT 1)),
goes AS (SELECT coalesce(p, q) AS p, member FROM found LEFT JOIN matched USING (q)),
life AS (SELECT DISTINCT p AS campaign_id, 'campaign_created' AS event_type, p AS event_value FROM goes WHERE p NOT IN (SELECT p FROM was)
UNION ALL SELECT p, 'indicator_added', member FROM goes WHERE p IN (SELECT p FROM was) AND (p, member) NOT IN (SELECT p, member FROM was)
UNION ALL SELECT p, 'indicator_removed', member FROM was WHERE p IN (SELECT p FROM goes) AND (p, member) NOT IN (SELECT p, member FROM goes)
UNION ALL SELECT DISTINCT p, 'campaign_resolved', p FROM was WHERE p NOT IN (SELECT p FROM goes))"""


@query(f"{_LIFE} SELECT * FROM life")
def campaign_lifecycle(s, d):
    """Events from the campaigns of the first half of the pages to those of the second."""
    was = lifecycle.memberships(_half(s, d, True))
    return lifecycle.step(was, _half(s, d, False))[1]


@query(f"{_LIFE} SELECT p AS campaign_id, q AS found_id, k AS overlap FROM matched JOIN edge USING (p, q)")
def campaign_matches(s, d):
    old, new = graph.checkpointed(lifecycle.memberships(_half(s, d, True))), graph.checkpointed(lifecycle.memberships(_half(s, d, False)))
    return lifecycle.match(old, new)


# derived edges and components ----------------------------------------------------------------------

_HUBS = f"""{_EDGES}, links AS (SELECT DISTINCT src_value AS node, dst_label || ':' || dst_value AS hub FROM edges WHERE src_label = 'Domain' AND rel IN {relations.HUBS}),
deg AS (SELECT hub, count(*) AS degree FROM links GROUP BY hub), weighed AS (SELECT * FROM links JOIN deg USING (hub)),
prof AS (SELECT node, array_to_string(list(hub ORDER BY degree, hub), chr(2)) AS profile FROM weighed GROUP BY node),
placed AS (SELECT hub, node, row_number() OVER (PARTITION BY hub ORDER BY profile, node) AS k FROM weighed JOIN prof USING (node)),
near AS (SELECT DISTINCT least(x.node, y.node) AS a, greatest(x.node, y.node) AS b FROM placed x JOIN placed y ON x.hub = y.hub AND y.k BETWEEN x.k + 1 AND x.k + {relations.SPAN}),
scored AS (SELECT a, b, round(sum(1.0 / x.degree), 9) AS weight, count(*) AS shared FROM near JOIN weighed x ON x.node = a JOIN links y ON y.node = b AND y.hub = x.hub GROUP BY ALL),
ends AS (SELECT a AS node, b AS other, weight FROM scored UNION ALL SELECT b, a, weight FROM scored),
best AS (SELECT DISTINCT least(node, other) AS a, greatest(node, other) AS b FROM (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY node ORDER BY weight DESC, other) <= {relations.BEST}))"""


@query(f"WITH {_HUBS} SELECT 'Domain' AS src_label, a AS src_value, 'RELATED_TO' AS rel, 'Domain' AS dst_label, b AS dst_value, CAST(weight AS DOUBLE) AS weight FROM scored JOIN best USING (a, b)")
def related_edges(s, d):
    return relations.related_edges(_edges(s, d)[1])


@query(f"{_MEM} SELECT 'Indicator' AS src_label, member AS src_value, 'BELONGS_TO_CAMPAIGN' AS rel, 'Campaign' AS dst_label, campaign_id AS dst_value FROM mem")
def campaign_edges(s, d):
    return relations.campaign_edges(lifecycle.memberships(_found(s, d)))


@query(f"WITH {_ENR} SELECT DISTINCT 'IP' AS src_label, ip AS src_value, 'RESOLVES_TO_ASN' AS rel, 'ASN' AS dst_label, asn AS dst_value FROM asn1 WHERE asn IS NOT NULL AND ip IN (SELECT unnest(string_split(resolved_ips, ',')) FROM enr UNION SELECT value FROM enr WHERE type = 'ip')")
def network_edges(s, d):
    """Networks of the addresses that indicators are or resolve to."""
    ind, e = _enriched(s, d)
    own = ind.filter("type = 'ip'").select(F.col("value").alias("ip")).unionByName(e.select(F.explode(C.split_list(F.col("resolved_ips"))).alias("ip")))
    return relations.network_edges(enrich.asn_facts(X.references(s, d)[0]).join(own.distinct(), "ip", "left_semi"))


@query(f"WITH {_EDGES} SELECT src_label, src_value, 'SERVED_BY' AS rel, dst_label, dst_value FROM edges WHERE rel = 'HOSTED_BY'")
def served_by_edges(s, d):
    return relations.served_by(_edges(s, d)[1])


@query(f"""WITH RECURSIVE {_EDGES}, near AS (SELECT src_label || chr(1) || src_value AS a, dst_label || chr(1) || dst_value AS b FROM edges UNION SELECT dst_label || chr(1) || dst_value, src_label || chr(1) || src_value FROM edges),
least(node, comp) USING KEY (node) AS (SELECT a, min(a) FROM near GROUP BY a UNION SELECT n.a, min(l.comp) FROM near n JOIN least l ON n.b = l.node JOIN recurring.least r ON r.node = n.a WHERE l.comp < r.comp GROUP BY n.a)
SELECT split_part(node, chr(1), 1) AS label, split_part(node, chr(1), 2) AS value, split_part(comp, chr(1), 1) AS component_label, split_part(comp, chr(1), 2) AS component_value FROM least""")
def graph_components(s, d):
    return components.of_graph(_edges(s, d)[1])


@query(f"""WITH {_EDGES},
one AS (SELECT rel, src_label AS label, src_value AS value FROM edges WHERE dst_value = '10.1.1.1' UNION SELECT rel, dst_label, dst_value FROM edges WHERE src_value = '10.1.1.1') SELECT * FROM one""")
def pivot_related(s, d):
    """What an address is linked with."""
    return lookup.related(_edges(s, d)[1], "10.1.1.1")


# what arrives bit by bit ---------------------------------------------------------------------------

_ARRIVED = X.IOC.replace("ioc(seq, value, type, source, confidence)", "arrived(came, value, type, source, confidence)") + ", ioc AS (SELECT row_number() OVER (ORDER BY came) - 1 AS seq, value, type, source, confidence FROM arrived)"


@query(f"WITH {_ARRIVED} SELECT seq, value, type, source FROM ioc")
def queue_in_order(s, d):
    """Messages pushed in their order, read from the queue's files, and numbered by arrival."""
    path = shared_folder(s)
    queue.push(X.ioc(s, d), path, order="seq")
    return queue.in_order(queue.pop_all(s, path)).select("seq", "value", "type", "source")


def _streamed(s: SparkSession, d: str, name: str) -> DataFrame:
    """A table that the stream writes from a queue of all messages."""
    folder = shared_folder(s)
    queue.push(X.ioc(s, d), f"{folder}/queue", order="seq")
    stream.start(s, f"{folder}/queue", f"{folder}/out").awaitTermination()
    return stream.table(s, f"{folder}/out", name)


_STREAMED = _IND.replace(X.IOC, _ARRIVED)


@query(f"WITH {_STREAMED} SELECT id, value, type, source, confidence FROM ind")
def stream_indicators(s, d):
    return _streamed(s, d, "indicators").select("id", "value", "type", "source", "confidence")


@query(f"WITH {_STREAMED} SELECT seq, id AS indicator_id, j.source, j.confidence FROM judged j JOIN ind ON j.nvalue = ind.value AND j.type = ind.type WHERE ok")
def stream_sightings(s, d):
    return _streamed(s, d, "metadata").select("seq", "indicator_id", "source", "confidence")


def _thirds(df: DataFrame, key: str) -> list[DataFrame]:
    return [df.filter(F.pmod(F.xxhash64(key), F.lit(3)) == i) for i in range(3)]


def _grown_graph(s: SparkSession, d: str) -> GraphStore:
    """All indicators in three deltas, of which together they are the whole table."""
    ind, e = _enriched(s, d)
    e = graph.checkpointed(e)
    store = GraphStore(s, shared_folder(s), buckets=64)
    for run, part in enumerate(zip(_thirds(ind, "id"), _thirds(e, "indicator_id")), 1):
        store.apply(run, part)
    return store


@query(f"WITH {_EDGES} SELECT * FROM edges")
def graph_edges_grown(s, d):
    return _grown_graph(s, d).edges()


@query(SQL["graph_nodes"])
def graph_nodes_grown(s, d):
    return _grown_graph(s, d).nodes()


@query(SQL["leader_clusters"])
def leader_clusters_grown(s, d):
    """Hosts in the order of arrival, in three appends."""
    values = graph.checkpointed(_values(s, d))
    cuts = values.select(F.percentile("pos", F.array(F.lit(0.33), F.lit(0.66)))).first()[0] or [0, 0]
    grown = cluster.Leaders(s, shared_folder(s))
    pos = F.col("pos")
    for run, part in enumerate((pos <= cuts[0], (pos > cuts[0]) & (pos <= cuts[1]), pos > cuts[1])):
        grown.append(values.filter(part), run)
    return grown.members()


@query(SQL["pivot_domain"])
def pivot_domain_trigrams(s, d):
    postings = trigrams.Postings(s, shared_folder(s), buckets=64)
    for run, part in enumerate(_thirds(graph.checkpointed(_indicators(s, d)), "id")):
        postings.append(part, run)
    return postings.pivot("example.n_t")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS kind, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY ALL)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, kind, n, first_at, last_at FROM w WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def event_windows(s, d):
    """Events an hour and type, as a stream with a watermark closes the hours."""
    base, schema = shared_folder(s), X.read(s, d, "events").schema
    # a pattern, as a stream takes a file or a folder only so
    rows = s.readStream.schema(schema).parquet(f"{d}/event[s].parquet").select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("kind"))
    windows.start(rows, base).awaitTermination()
    return windows.table(s, base)
