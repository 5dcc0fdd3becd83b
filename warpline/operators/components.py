"""Connected components by contraction.

In a round every node takes the least hash among itself, its neighbours and theirs; nodes with one hash lie in one component
and become one node, and edges inside it go. Hashes are new in each round, so a path shrinks to about a third, and what lies around a
hub becomes one node at once: the number of rounds grows with the logarithm of the nodes. Hubs are met by minima, which are
combined before the shuffle. Each round's table of (node, merged node) is stored; they are composed backwards, from the smallest up.
Published methods: Lacki, Mirrokni, Wlodarczyk, Connected Components at Scale via Local Contractions, 2018.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warpline.operators.graph import _undirected
from warpline.session import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(node, component) of each node of links (a, b), in one direction or both; component is the component's least node.

    Nulls are dropped; a node that is linked with itself only is a component of its own.
    """
    links = links.select("a", "b").filter("a is not null and b is not null")
    ends = checkpointed(links.select("a").unionByName(links.select(F.col("b").alias("a"))).distinct())
    key = checkpointed(ends.select(F.col("a").alias("node"), F.xxhash64("a").alias("x"), F.xxhash64(F.lit(1), "a").alias("y")))
    # 128 bits stand for a node from here on
    left, right = key.select(F.col("node").alias("a"), F.struct("x", "y").alias("u")), key.select(F.col("node").alias("b"), F.struct("x", "y").alias("v"))
    now = links.filter("a <> b").join(left, "a").join(right, "b").select("u", "v")
    now = checkpointed(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    rounds: list[DataFrame] = []
    while not now.isEmpty():
        r = len(rounds)
        mark = lambda c: F.struct(F.xxhash64(F.lit(r), c).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        one = checkpointed(now.groupBy("u").agg(F.least(F.min(mark("v")), F.min(mark("u"))).alias("m")))
        two = now.join(one.select(F.col("u").alias("v"), F.col("m").alias("w")), "v").groupBy("u").agg(F.min("w").alias("w"))
        to = checkpointed(two.join(one, "u").select("u", F.least("w", "m")["n"].alias("to")))
        rounds.append(to)
        merged = now.join(to.withColumnRenamed("to", "p"), "u").join(to.select(F.col("u").alias("v"), F.col("to").alias("q")), "v")
        now = checkpointed(merged.filter("p <> q").select(F.col("p").alias("u"), F.col("q").alias("v")).distinct())
    whole = None
    for to in reversed(rounds):  # nodes of a round that end there, or go on as another
        if whole is None:
            whole = to
        else:
            on = to.join(whole.select(F.col("u").alias("to"), F.col("to").alias("end")), "to", "left")
            whole = checkpointed(on.select("u", F.coalesce("end", "to").alias("to")))
    named = key.select("node", F.struct("x", "y").alias("u"))
    if whole is not None:
        named = named.join(whole, "u", "left").select("node", F.coalesce("to", "u").alias("u"))
    named = checkpointed(named)
    return named.join(named.groupBy("u").agg(F.min("node").alias("component")), "u").select("node", "component")


def of_graph(edges: DataFrame) -> DataFrame:
    """label, value, component_label, component_value: components of the whole graph, all nodes and kinds of edges."""
    both = _undirected(edges)
    own = edges.select(F.concat("src_label", F.lit("\u0001"), "src_value").alias("a")).select("a", F.col("a").alias("b"))
    part = lambda c, i: F.split_part(F.col(c), F.lit("\u0001"), F.lit(i))
    value = lambda c: F.substring(F.col(c), F.instr(F.col(c), "\u0001") + F.lit(1), F.length(c))
    found = components(both.unionByName(own))
    return found.select(part("node", 1).alias("label"), value("node").alias("value"), part("component", 1).alias("component_label"), value("component").alias("component_value"))
