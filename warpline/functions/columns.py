"""Column expressions: text, urls, validation, normalisation, ids, scores. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
URI = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)"
DOMAIN = r"^(?:[a-z0-9-]{1,63}\.)+[a-z]{2,}\n?\z"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"{OCTET}(?:\.{OCTET}){{3}}"
#: schemes whose last path segment can carry ;parameters (fixed values)
PARAM_SCHEMES = ("", "ftp", "hdl", "prospero", "http", "https", "rtsp", "rtsps", "sip", "sips", "mms", "sftp", "shttp")
#: hosting platforms by suffix, the first that fits wins (fixed values)
HOSTING = (
    ("github.io", "GitHub Pages"),
    ("vercel.app", "Vercel"),
    ("webflow.io", "Webflow"),
    ("netlify.app", "Netlify"),
    ("pages.dev", "Cloudflare Pages"),
    ("blogspot.com", "Google Blogger"),
    ("firebaseapp.com", "Firebase Hosting"),
    ("appspot.com", "Google App Engine"),
)


def _ipv6() -> str:
    """Eight groups, or fewer around one ::, the last two of which may be an IPv4 address; then a scope."""
    h = "[0-9A-Fa-f]{1,4}"
    forms = [f"(?:{h}:){{7}}{h}", f"(?:{h}:){{6}}{IPV4}"]
    for k in range(8):
        left = f"{h}(?::{h}){{{k - 1}}}" if k else ""
        right = [""]
        if k < 7:
            right.append(f"{h}(?::{h}){{0,{6 - k}}}")
        if k < 6:
            right.append(f"(?:{h}:){{0,{5 - k}}}{IPV4}")
        forms.append(f"{left}::(?:{'|'.join(right)})")
    return f"(?:{'|'.join(forms)})(?:%[^%]+)?"


IPV6 = _ipv6()


def strip(c: Column) -> Column:
    return F.regexp_replace(c, BLANKS, "")


def split_list(c: Column) -> Column:
    """Comma list to trimmed, non-empty parts."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


def _url_text(c: Column) -> Column:
    """What a URL parser sees: no leading control characters or blanks, no tabs or line ends."""
    return F.regexp_replace(F.regexp_replace(c, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(_url_text(c), URI, 1))


def netloc(c: Column) -> Column:
    return F.regexp_extract(_url_text(c), URI, 2)


def path(c: Column) -> Column:
    whole = F.regexp_extract(_url_text(c), URI, 3)
    return F.when(scheme(c).isin(*PARAM_SCHEMES), F.regexp_replace(whole, r";[^/]*$", "")).otherwise(whole)


def url_breaks(c: Column) -> Column:
    """Urls that a parser refuses: one square bracket without the other in the authority."""
    return F.contains(netloc(c), F.lit("[")) != F.contains(netloc(c), F.lit("]"))


def url_host(c: Column) -> Column:
    """Host of a url, or the value itself, in lower case."""
    return F.lower(F.coalesce(F.nullif(netloc(c), F.lit("")), c))


def valid_domain(c: Column) -> Column:
    return ~F.contains(c, F.lit("..")) & ~F.startswith(c, F.lit("-")) & c.rlike(DOMAIN)


def valid_ip(c: Column) -> Column:
    return c.rlike(rf"^{IPV4}\z") | c.rlike(rf"^{IPV6}\z")


def valid_url(c: Column) -> Column:
    return (scheme(c) != "") & (netloc(c) != "")


def valid_hash(c: Column) -> Column:
    return F.length(c).isin(32, 40, 64)


def _by_type(kind: Column, otherwise: Column, **cases: Column) -> Column:
    out = F.when(F.lower(kind) == "domain", cases["domain"]).when(F.lower(kind) == "ip", cases["ip"])
    return out.when(F.lower(kind) == "url", cases["url"]).when(F.lower(kind) == "hash", cases["hash"]).otherwise(otherwise)


def valid(value: Column, kind: Column) -> Column:
    """Types other than domain, ip, url and hash pass."""
    return _by_type(kind, F.lit(True), domain=valid_domain(value), ip=valid_ip(value), url=valid_url(value), hash=valid_hash(value))


def reason(value: Column, kind: Column) -> Column:
    return F.when(~valid(value, kind), F.concat(F.lit("invalid "), F.lower(kind)))


def normal_domain(c: Column) -> Column:
    low = F.lower(strip(c))
    host = F.when(F.startswith(low, F.lit("http://")) | F.startswith(low, F.lit("https://")), netloc(low)).otherwise(low)
    return F.regexp_replace(host, r"^www\.", "")


def normal_url(c: Column) -> Column:
    s = strip(c)
    return F.concat(scheme(s), F.lit("://"), F.lower(netloc(s)), F.regexp_replace(path(s), "/+$", ""))


def normal_hash(c: Column) -> Column:
    return F.lower(strip(c))


def normal_ip(c: Column) -> Column:
    return strip(c)


def normal(value: Column, kind: Column) -> Column:
    return _by_type(kind, value, domain=normal_domain(value), ip=normal_ip(value), url=normal_url(value), hash=normal_hash(value))


def hosting(domain: Column) -> Column:
    """Platform of a domain by suffix, without regard to label borders."""
    out = F.when(F.endswith(domain, F.lit(HOSTING[0][0])), F.lit(HOSTING[0][1]))
    for suffix, name in HOSTING[1:]:
        out = out.when(F.endswith(domain, F.lit(suffix)), F.lit(name))
    return out


def clean_list(a: Column) -> Column:
    """Trimmed, lower-cased, distinct and non-empty parts joined by commas; null if none."""
    parts = F.filter(F.transform(a, lambda x: F.lower(strip(x))), lambda x: x.isNotNull() & (x != ""))
    return F.nullif(F.array_join(F.array_distinct(parts), ","), F.lit(""))


def asn_token(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^\s*(\S+)", 1), F.lit(""))


def undotted(c: Column) -> Column:
    return F.regexp_replace(c, r"\.+$", "")


def campaign_key(members: Column) -> Column:
    """The whole digest of a cluster's sorted members: what tells campaigns apart, as shorter ids can collide."""
    return F.sha2(F.array_join(F.array_sort(members), "|"), 256)


def campaign_id(members: Column) -> Column:
    """A stable label of a cluster: from the digest of its sorted members."""
    digest = F.substring(campaign_key(members), 1, 15)
    return F.concat(F.lit("campaign_"), F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(10_000_000_000)).cast("string"))


def member_kind(c: Column) -> Column:
    """What the scorer takes a member for; a dotted value is always a domain."""
    return F.when(F.startswith(c, F.lit("http")), F.lit("url")).when(F.contains(c, F.lit(".")), F.lit("domain")).otherwise(F.lit("hash"))


def score(members: Column) -> Column:
    n = F.size(members)
    base = F.when(n >= 10, 40).when(n >= 5, 25).when(n >= 3, 15).otherwise(5)
    return F.least(base + 10 * F.size(F.array_distinct(F.transform(members, member_kind))), F.lit(100))


def strength(score_: Column) -> Column:
    return F.when(score_ >= 80, "high").when(score_ >= 50, "medium").otherwise("low")


def technique(value: Column, keywords: tuple[tuple[str, str], ...]) -> Column:
    """Techniques whose keyword the value contains, in the order of keywords."""
    return F.array_compact(F.array(*[F.when(F.contains(value, F.lit(k)), F.lit(t)) for k, t in keywords]))


#: fixed values: keywords of domains and urls
DOMAIN_KEYWORDS = (("login", "T1566"), ("auth", "T1078"), ("update", "T1105"))
URL_KEYWORDS = (("phish", "T1566"), ("download", "T1105"))
