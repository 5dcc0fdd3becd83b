"""Declared schemas of all stored tables; readers never infer."""

from __future__ import annotations

IOC = "seq long, value string, type string, source string, confidence int"
INDICATORS = "id long, value string, type string, source string, confidence int, created_at timestamp"
RAW = "seq long, value string, type string, source string, confidence int, raw_payload string, created_at timestamp"
REJECTED = "seq long, value string, type string, source string, reason string, created_at timestamp"
METADATA = "seq long, indicator_id long, source string, confidence int, first_seen timestamp"
ENRICHMENT = "indicator_id long, asn string, registrar string, hosting_provider string, nameservers string, resolved_ips string, ssl_fingerprint string, created_at timestamp"
CAMPAIGNS = "campaign_id string, confidence int, strength string, indicator_count int, created_at timestamp, campaign_key string"
MEMBERSHIPS = "campaign_id string, member string"
TIMELINE = "id long, campaign_id string, event_type string, event_value string, source string, created_at timestamp"
FEEDS = "name string, last_run timestamp_ntz, last_success timestamp_ntz, indicators_collected int, status string"
FEED_SOURCES = "id long, name string, description string"
FEED_RUNS = "id long, feed_source_id long, status string, indicators_collected int, started_at timestamp, completed_at timestamp"
NODES = "label string, value string, type string, source string, confidence int"
EDGES = "src_label string, src_value string, rel string, dst_label string, dst_value string"
REF_ASN = "ip string, as_text string, isp string, status string"
REF_DNS = "domain string, nameservers array<string>, ips array<string>"
REF_WHOIS = "domain string, registrar array<string>"
