"""Enrichment of indicators by joins with reference tables (networks, DNS, registrars).

The joins are left to Catalyst: small references are broadcast by their measured size, large ones are
shuffled; keys are unique on the reference side after first-per-key, so no join multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warpline.functions import columns as C


def asn_facts(ref_asn: DataFrame) -> DataFrame:
    """ip, asn, provider of successful look-ups."""
    ok = ref_asn.filter("status = 'success'").select("ip", C.asn_token(F.col("as_text")).alias("asn"), F.col("isp").alias("provider"))
    return ok.groupBy("ip").agg(F.min(F.struct("asn", "provider")).alias("a")).select("ip", "a.asn", "a.provider")


def dns_facts(ref_dns: DataFrame) -> DataFrame:
    """domain, ns (cleaned list), ips (cleaned list), first_ip; rows without either are no answer, of several answers the least counts."""
    rows = ref_dns.filter((F.coalesce(F.size("nameservers"), F.lit(0)) > 0) | (F.coalesce(F.size("ips"), F.lit(0)) > 0))
    ns = F.transform("nameservers", C.undotted)
    answer = F.struct(C.clean_list(ns).alias("ns"), C.clean_list(F.col("ips")).alias("ips"), F.try_element_at("ips", F.lit(1)).alias("first_ip"))
    return rows.groupBy("domain").agg(F.min(answer).alias("d")).select("domain", "d.*")


def registrar_facts(ref_whois: DataFrame) -> DataFrame:
    """domain, registrar; of several answers the least."""
    return ref_whois.groupBy("domain").agg(F.min(F.try_element_at("registrar", F.lit(1))).alias("registrar"))


def pending(indicators: DataFrame, stored: DataFrame) -> DataFrame:
    return indicators.join(stored.select(F.col("indicator_id").alias("id")), "id", "left_anti")


def enrich(indicators: DataFrame, ref_asn: DataFrame, ref_dns: DataFrame, ref_whois: DataFrame) -> DataFrame:
    """One row an indicator; types are compared exactly, so others get nulls only."""
    lower = F.lower("value")
    domain = F.when(F.col("type") == "domain", lower).when(F.col("type") == "url", C.url_host(F.col("value")))
    base = indicators.select(F.col("id").alias("indicator_id"), "value", "type", F.nullif(domain, F.lit("")).alias("domain"))
    dns, whois, asn = dns_facts(ref_dns), registrar_facts(ref_whois), asn_facts(ref_asn)
    named = base.join(dns, "domain", "left").join(whois, "domain", "left")
    keyed = named.withColumn("ip", F.when(F.col("type") == "ip", F.col("value")).otherwise(F.col("first_ip")))
    full = keyed.join(asn, "ip", "left")
    provider = F.coalesce(C.hosting(F.col("domain")), F.col("provider"))
    return full.select("indicator_id", "asn", "registrar", provider.alias("hosting_provider"), F.col("ns").alias("nameservers"), F.col("ips").alias("resolved_ips"), F.lit(None).cast("string").alias("ssl_fingerprint"))


def events(enriched: DataFrame, indicators: DataFrame) -> DataFrame:
    rows = enriched.join(indicators.select(F.col("id").alias("indicator_id"), "value"), "indicator_id")
    return rows.select(F.lit("infrastructure_enriched").alias("event_type"), F.col("value").alias("event_value"), F.lit("enrichment_worker").alias("source"))
