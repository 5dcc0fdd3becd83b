"""URL filters: a sort-merge range join of page urls with host and path rules.

A host is keyed by its labels in reverse, each ended by U+0001 (www.example.com: com, example, www), and a
rule by its host's key, U+0000 and its path, so a rule's paths are one interval [key, key + U+10FFFF) of keys.
Intervals nest or are disjoint. A url is looked up under its host and each host that this is a subdomain of: as
many keys as the host has labels. Each rule gives two events: a push at its start, with itself on top of the stack
of rules that are open then, and a pop at its end, with its parent on top again. The top is the longest
open rule of its host, so an event carries one rule, however many a host has. Sorting keys of urls and events
and carrying the last top along (a running window) gives each key its rule; of a url's keys the longest
rule text (host + path) wins, then the longest host.

Equal urls of a page are looked up once. Events are sorted by range into runs; keys of urls go to the run
whose first key is the last one at or below their own. A run with many urls is dealt over salts in
proportion, and each salt gets the events of its run, so a host with a third of all pages is spread
evenly. A run but the first starts with the rule that was open before it. All work is DataFrame expressions.

Defined cases: a null url, or one without "://", has an empty host and path and fits no rule; repeated
rows and ties keep their rows; an empty page table gives an empty result; a rule with a null or empty
host fits no page; repeated rules count once, allow before block; any character may stand in a host or path.
Columns besides id and url are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warpline.llm.common import materialise

END, LAST = "\u0001", "\U0010FFFF"
#: events of a run; keys of urls of a salt
CHUNK, KEYS = 20_000, 200_000
FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, FROM, FROM.lower())


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first :// up to / ? # or end, path from there up to ? # or end."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    cut = F.substring_index(F.substring_index(after, "#", 1), "?", 1)
    host = F.substring_index(cut, "/", 1)
    path = F.substring(cut, F.length(host) + F.lit(1), F.length(cut))
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def escaped(c: Column) -> Column:
    """The text without END and LAST, which mark borders of keys; U+0000 sorts before all that is left."""
    plain = F.replace(c, F.lit("\u0002"), F.lit("\u0002\u0003"))
    plain = F.replace(F.replace(plain, F.lit(END), F.lit("\u0002\u0004")), F.lit(LAST), F.lit("\u0002\u0005"))
    return F.replace(plain, F.lit("\u0000"), F.lit("\u0002\u0006"))


def labels(host: Column) -> Column:
    return F.reverse(F.split(escaped(host), "\\."))


def key_of(labels_: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels_, END), F.lit(END + "\u0000"), escaped(path))


RULE = "struct<len: int, hlen: int, rule: string, verdict: string>"


def _events(rules: DataFrame) -> DataFrame:
    """(key, pop, top): which rule is the longest open one from this key on; null: none."""
    r = (
        rules.select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.lower("verdict").alias("verdict"))
        .filter(F.length("host") > 0)
        .groupBy("host", "path")
        .agg(F.min("verdict").alias("verdict"))
    )
    top = F.struct((F.length("host") + F.length("path")).alias("len"), F.length("host").alias("hlen"), F.concat("host", "path").alias("rule"), "verdict")
    r = r.select("host", "path", F.length("path").alias("size"), key_of(labels(F.col("host")), F.col("path")).alias("key"), top.cast(RULE).alias("top"))
    # a rule's parent has the longest of its proper prefixes; only lengths that the host's rules have are tried
    sizes = r.groupBy("host").agg(F.collect_set("size").alias("sizes"))
    shorter = F.filter("sizes", lambda n: n < F.col("size"))
    tried = r.join(sizes, "host").select("host", "key", F.explode(shorter).alias("n"), "path").select("host", "key", F.expr("substring(path, 1, n)").alias("path"))
    parents = tried.join(r.select("host", "path", F.col("top").alias("parent")), ["host", "path"]).groupBy("key").agg(F.max("parent").alias("parent"))
    full = r.join(parents, "key", "left")
    push = full.select("key", F.lit(0).alias("pop"), "top")
    # of pops at one place the outermost rule's comes last
    return push.unionByName(full.select(F.concat("key", F.lit(LAST)).alias("key"), (F.lit(2**30) - F.col("size")).alias("pop"), F.col("parent").alias("top")))


def _place(edges: list[str], key: Column) -> Column:
    """How many of the sorted edges are at or below the key: a binary search in one literal, so a key costs the logarithm of the runs."""
    if not edges:
        return F.lit(0)
    steps = F.sequence(F.lit(1), F.lit(len(edges).bit_length()))
    low, high = (lambda s: s["low"]), (lambda s: s["high"])
    middle = lambda s: F.floor((low(s) + high(s)) / 2).cast("int")
    below = lambda s: F.element_at(F.lit(edges), middle(s) + 1) <= key
    step = lambda s, _: F.when(low(s) >= high(s), s).otherwise(F.struct(F.when(below(s), middle(s) + 1).otherwise(low(s)).alias("low"), F.when(below(s), high(s)).otherwise(middle(s)).alias("high")))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(edges)).alias("high")), step)["low"]


def match(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Each page with host, path, rule (null where none fits) and verdict."""
    events = materialise(_events(rules))
    runs = max(1, -(-events.count() // CHUNK))
    ranged = materialise(events.repartitionByRange(runs, "key").withColumn("run", F.spark_partition_id()))
    ends = ranged.groupBy("run").agg(F.min("key").alias("first"), F.max_by("top", F.struct("key", "pop")).alias("top"))  # one row a run
    firsts = sorted(r["first"] for r in ends.select("first").collect())
    edges = firsts[1:]
    place = lambda key: _place(edges, key)

    host, path = split_url(F.col("url"))
    urls = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.groupBy("page_id", "host", "path").agg(F.count("*").alias("copies"))
    urls = materialise(urls)
    own = labels(F.col("host"))
    keys = urls.withColumn("labels", own).withColumn("depth", F.explode(F.expr("sequence(1, size(labels))")))
    keys = keys.withColumn("key", key_of(F.slice("labels", 1, F.col("depth")), F.col("path"))).withColumn("run", place(F.col("key")))
    weights = keys.groupBy("run").agg(F.count("*").alias("n")).collect()  # one row a run
    salts = {r["run"]: -(-r["n"] // KEYS) for r in weights}
    many = F.element_at(F.lit([salts.get(r, 1) for r in range(len(edges) + 1)]), F.col("run") + 1)
    keys = keys.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), many).cast("int"))
    events = ranged.withColumn("run", place(F.col("key"))).select("run", "key", F.col("pop").alias("at"), "top")
    carried = ends.select((place(F.col("first")) + 1).cast("int").alias("run"), F.lit("").alias("key"), F.lit(-1).alias("at"), "top").filter(F.col("run") <= len(edges))
    dealt = events.unionByName(carried).withColumn("salt", F.explode(F.sequence(F.lit(0), many.cast("int") - 1)))
    none = F.lit(None)
    # an event's top is a set value even where no rule is open, so that it hides what was open before
    swept = dealt.select("run", "salt", "key", "at", F.struct("top").alias("state"), none.cast(urls.schema["page_id"].dataType).alias("page_id"), none.cast("string").alias("host"), none.cast("string").alias("path"), none.cast("long").alias("copies")).unionByName(
        keys.select("run", "salt", "key", F.lit(2**31 - 1).alias("at"), none.cast(f"struct<top: {RULE}>").alias("state"), "page_id", "host", "path", "copies")
    )
    running = Window.partitionBy("run", "salt").orderBy("key", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = swept.withColumn("open", F.last("state", ignorenulls=True).over(running)["top"]).filter(F.col("host").isNotNull())
    best = opened.groupBy("page_id", "host", "path").agg(F.max("open").alias("best"), F.first("copies").alias("copies"))
    whole = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return whole.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
