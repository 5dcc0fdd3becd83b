"""Registered queries read their tables whole; sf0.001 has 50 pages and 150 customers."""

import os
import subprocess
import sys

import pytest

from warpline.operators import graph
from warpline.plans import fixtures as X
from warpline.plans import registry

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_feeds_parse_all_pages(spark):
    pages = X.read(spark, SF, "pages").filter("url is not null").count()
    assert pages > 40
    assert {r.source: r.n for r in registry.feed_counts(spark, SF).collect()} == dict.fromkeys(("openphish", "otx", "threatfox", "malwarebazaar"), pages)
    assert registry.feed_union(spark, SF).count() == 4 * pages
    assert registry.feed_text_parse(spark, SF).count() == registry.feed_json_parse(spark, SF).count() == 2 * pages


def test_messages_hold_all_customers(spark):
    assert X.ioc(spark, SF).filter("source = 'manual'").count() == X.read(spark, SF, "customer").count() > 20


@pytest.fixture(scope="module")
def reached(spark):
    """What each typed node reaches in four steps over all edges, by breadth-first search."""
    near = {}
    for r in registry.graph_edges(spark, SF).collect():
        a, b = (r.src_label, r.src_value), (r.dst_label, r.dst_value)
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for start in (n for n in near if n[0] in graph.TYPED):
        seen, frontier = {start}, {start}
        for _ in range(4):
            frontier = {m for n in frontier for m in near[n]} - seen
            seen |= frontier
        out[start] = {n for n in seen if n[0] in graph.TYPED and n != start}
    return out


def test_traversal_of_the_whole_graph(spark, reached):
    urls = {r.url for r in X.read(spark, SF, "pages").collect()}
    got = [(r.start, r.node) for r in registry.graph_reach4(spark, SF).collect()]
    assert sorted(got) == sorted((s[1], n[1]) for s, ns in reached.items() for n in ns)
    assert len({s for s, _ in got} & urls) > len(urls) / 5


def test_clusters_of_the_whole_graph(spark, reached):
    want = {tuple(sorted({s[1]} | {n[1] for n in ns})) for s, ns in reached.items()}
    want = {"|".join(c) for c in want if len(c) > 1}
    assert {r.cluster for r in registry.graph_clusters(spark, SF).collect()} == want
    assert {r.indicators for r in registry.graph_candidates(spark, SF).collect()} == want


HIDDEN = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name.partition(".")[0] in {names!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), any(q.startswith("op") for q in e.queries()))
"""


@pytest.mark.parametrize("names", [("xxhash",), ("zstandard",), ("tokenizers", "public_tokenizers"), ("sentencepiece",)])
def test_engine_queries_do_not_need_the_corpus_packages(names):
    out = subprocess.run([sys.executable, "-c", HIDDEN.format(names=names)], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert out == [str(len(registry.queries())), str(len(registry.oracle_sql())), "False"]


def test_every_engine_query_has_a_twin():
    assert set(registry.queries()) == set(registry.oracle_sql())
