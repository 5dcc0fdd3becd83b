"""IOC messages and reference tables derived from the generic test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from warpline.functions import columns as C

IPS, HEX40 = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", "[0-9a-f]{40}"
STEP = 10_000
#: hand-made messages that reach the rarer rules
MESSAGES = [
    ("8.8.8.8", "ip", "a", 10), ("8.8.8.8", "ip", "b", 20), ("8.8.8.8", "IP", "c", 30), ("Evil.com", "domain", "a", 50),
    (" evil.com", "domain", "a", 50), ("evil.com", "domain", "a", 50), ("evil..com", "domain", "a", 50), ("-evil.com", "domain", "a", 50),
    ("evil-.com", "domain", "a", 50), ("x" * 64 + ".com", "domain", "a", 50), ("999.1.1.1", "ip", "a", 50), ("01.2.3.4", "ip", "a", 50),
    ("evil.com/x", "url", "a", 50), ("http://", "url", "a", 50), ("HTTP://Example.com/Test//?q=1#f", "url", "a", 50), ("http://example.com/Test", "url", "b", 60),
    ("http://a.com/p;x", "url", "a", 50), ("https://u:p@Evil.com:8080/a/b//?q=1#f", "url", "a", 50), ("ABCDEF" * 6 + "ABCD", "hash", "a", 50), ("abcd1234", "hash", "a", 50),
    ("anything", "md5_hash", "a", 50), ("", "domain", "a", 50), ("login.evil.com", "domain", "a", 101), ('{"data": 1}', "url", "a", 50),
    (' {"results": []}', "hash", "a", 50), ('{"x": 1}', "md5", "a", 50), ("y" * 2001, "md5", "a", 50), ("login-update.auth.net", "domain", "a", 50),
    ("http://x.com/phish/download", "url", "a", 50), ("foo.github.io", "domain", "a", 50), ("evilgithub.io", "domain", "a", 50), ("http://shop.vercel.app/x", "url", "a", 50),
]


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ioc(spark: SparkSession, sf: str) -> DataFrame:
    """seq, value, type, source, confidence: page urls, their hosts, addresses and digests in texts, bad values."""
    pages, docs, customers = read(spark, sf, "pages"), read(spark, sf, "documents"), read(spark, sf, "customer")

    def part(df: DataFrame, ord_: int, key: str, pos: str | None, value, kind: str, source: str, confidence: int) -> DataFrame:  # noqa: ANN001
        seq = F.lit(ord_ * 10**13).cast("long") + F.col(key) * STEP + (F.col(pos) + 1 if pos else F.lit(0))
        return df.select(seq.cast("long").alias("seq"), value.alias("value"), F.lit(kind).alias("type"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))

    found = lambda pattern: docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("pos", "m"))
    out = part(pages.filter("url is not null"), 1, "page_id", None, F.col("url"), "url", "openphish", 80)
    out = out.unionByName(part(pages.filter("url is not null"), 2, "page_id", None, C.netloc(F.col("url")), "domain", "otx", 70))
    out = out.unionByName(part(found(IPS), 3, "doc_id", "pos", F.col("m"), "ip", "threatfox", 75))
    out = out.unionByName(part(found(HEX40), 4, "doc_id", "pos", F.col("m"), "hash", "malwarebazaar", 85))
    out = out.unionByName(part(customers, 5, "c_custkey", None, F.col("c_name"), "domain", "manual", 50))
    own = spark.createDataFrame([(6 * 10**13 + i * STEP, *m) for i, m in enumerate(MESSAGES)], "seq long, value string, type string, source string, confidence int")
    return out.unionByName(own)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


IOC = f"""ioc(seq, value, type, source, confidence) AS (
SELECT 10000000000000 + page_id * {STEP}, url, 'url', 'openphish', 80 FROM pages WHERE url IS NOT NULL
UNION ALL SELECT 20000000000000 + page_id * {STEP}, regexp_extract(url, '{C.URI}', 2), 'domain', 'otx', 70 FROM pages WHERE url IS NOT NULL
UNION ALL SELECT 30000000000000 + doc_id * {STEP} + i, l[i], 'ip', 'threatfox', 75 FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{IPS}') AS l FROM documents))
UNION ALL SELECT 40000000000000 + doc_id * {STEP} + i, l[i], 'hash', 'malwarebazaar', 85 FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{HEX40}') AS l FROM documents))
UNION ALL SELECT 50000000000000 + c_custkey * {STEP}, c_name, 'domain', 'manual', 50 FROM customer
UNION ALL SELECT * FROM (VALUES {", ".join(f"({6 * 10**13 + i * STEP}, {_q(v)}, {_q(t)}, {_q(s)}, {c})" for i, (v, t, s, c) in enumerate(MESSAGES))}))"""


def hosts(spark: SparkSession, sf: str, where: Column | None = None) -> DataFrame:
    """Distinct hosts of pages with infrastructure read off their names, as an enrichment table.

    indicator_id is a fixed number made from the host's order of first page, so no global sort is needed.
    """
    pages = read(spark, sf, "pages")
    h = (pages if where is None else pages.filter(where)).filter("url is not null").select(C.netloc(F.col("url")).alias("host"), "page_id").groupBy("host").agg(F.min("page_id").alias("indicator_id"))
    lab = F.regexp_extract("host", r"([^.]*)\.example\.", 1)
    tld = F.regexp_extract("host", r"([^.]*)$", 1)
    sub = F.nullif(F.regexp_extract("host", r"^(blog|m|www)\.", 1), F.lit(""))
    ns = F.concat(F.lit("ns1."), F.substring(lab, 1, 2), F.lit(",ns2."), F.substring(lab, 1, 2))
    return h.select("indicator_id", F.col("host").alias("value"), F.concat(F.lit("AS"), (F.length(lab) + 13000).cast("string")).alias("asn"), tld.alias("registrar"), sub.alias("hosting_provider"), ns.alias("nameservers"), F.lit(None).cast("string").alias("resolved_ips"))


HOSTS = f"""host0 AS (SELECT regexp_extract(url, '{C.URI}', 2) AS value, min(page_id) AS indicator_id FROM pages WHERE url IS NOT NULL GROUP BY 1),
host1 AS (SELECT *, regexp_extract(value, '([^.]*)\\.example\\.', 1) AS lab, regexp_extract(value, '([^.]*)$', 1) AS tld,
  nullif(regexp_extract(value, '^(blog|m|www)\\.', 1), '') AS sub FROM host0),
hosts AS (SELECT indicator_id, value, 'AS' || (length(lab) + 13000) AS asn, tld AS registrar, sub AS hosting_provider,
  'ns1.' || substr(lab, 1, 2) || ',ns2.' || substr(lab, 1, 2) AS nameservers FROM host1)"""


def references(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ref_asn, ref_dns, ref_whois) for the domains and addresses of ioc()."""
    h = hosts(spark, sf)
    octet = F.pmod(F.length("value"), F.lit(50)).cast("string")
    ip = F.concat(F.lit("10.0.0."), octet)
    dns = h.select(F.col("value").alias("domain"), F.transform(F.split("nameservers", ","), lambda x: F.concat(F.lit(" "), F.upper(x), F.lit("."))).alias("nameservers"), F.array(ip, F.lit("10.1.1.1")).alias("ips"))
    dns = dns.unionByName(spark.createDataFrame([("evil.com", ["ns.evil.com."], []), ("login-update.auth.net", None, ["8.8.8.8"]), ("a.com", [], [])], dns.schema))
    asn = spark.range(50).select(F.concat(F.lit("10.0.0."), F.col("id").cast("string")).alias("ip"), F.concat(F.lit("AS"), (F.col("id") + 100).cast("string"), F.lit(" Net")).alias("as_text"), F.concat(F.lit("Isp "), F.col("id").cast("string")).alias("isp"), F.when(F.col("id") % 7 == 0, "fail").otherwise("success").alias("status"))
    asn = asn.unionByName(spark.createDataFrame([("8.8.8.8", "AS13335 Cloudflare, Inc.", "Cloudflare", "success"), ("9.9.9.9", "", "Quad", "success")], asn.schema))
    who = h.select(F.col("value").alias("domain"), F.when(F.length("value") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("registrar"), F.lit("other"))).alias("registrar"))
    return asn, dns, who


REFERENCES = f"""{HOSTS},
dns0 AS (SELECT value AS domain, list_transform(string_split(nameservers, ','), lambda x: ' ' || upper(x) || '.') AS nameservers,
  ['10.0.0.' || (length(value) % 50), '10.1.1.1'] AS ips FROM hosts
  UNION ALL SELECT 'evil.com', ['ns.evil.com.'], CAST([] AS VARCHAR[]) UNION ALL SELECT 'login-update.auth.net', NULL, ['8.8.8.8'] UNION ALL SELECT 'a.com', CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])),
clean AS (SELECT domain, nullif(array_to_string(list_sort(list_distinct(list_transform(nameservers, lambda x: lower(trim(regexp_replace(x, '\\.+$', '')))))), ','), '') AS ns,
  nullif(array_to_string(ips, ','), '') AS ips, ips[1] AS first_ip FROM dns0 WHERE coalesce(len(nameservers), 0) > 0 OR coalesce(len(ips), 0) > 0),
asn0 AS (SELECT '10.0.0.' || i AS ip, 'AS' || (i + 100) || ' Net' AS as_text, 'Isp ' || i AS isp, CASE WHEN i % 7 = 0 THEN 'fail' ELSE 'success' END AS status FROM range(50) t(i)
  UNION ALL SELECT '8.8.8.8', 'AS13335 Cloudflare, Inc.', 'Cloudflare', 'success' UNION ALL SELECT '9.9.9.9', '', 'Quad', 'success'),
asn1 AS (SELECT ip, nullif(regexp_extract(as_text, '^\\s*(\\S+)', 1), '') AS asn, isp AS provider FROM asn0 WHERE status = 'success'),
who AS (SELECT value AS domain, CASE WHEN length(value) % 3 = 0 THEN NULL ELSE registrar END AS registrar FROM hosts)"""
