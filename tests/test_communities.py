"""Communities against planted groups and all partitions of small graphs."""

import itertools
import math

import duckdb
import pytest

from weftgraph.operators import communities
from weftgraph.operators.graph import components, packed

EDGES = "source_id string, target_id string"


def graph_of(spark, pairs, more=()):
    names = sorted({x for p in pairs for x in p} | set(more))
    return spark.createDataFrame([(x,) for x in names], "node_id string"), spark.createDataFrame(list(pairs), EDGES)


def clique(names):
    return [p for p in itertools.permutations(names, 2)]


def groups(labels):
    out = {}
    for r in labels.collect():
        out.setdefault(r.community_id, set()).add(r.node_id)
    return sorted(map(frozenset, out.values()), key=sorted)


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for i in range(len(rest)):
            yield [*rest[:i], [items[0], *rest[i]], *rest[i + 1 :]]


def codelength(rates, flows, parts):
    x = lambda v: v * math.log2(v) if v > 0 else 0.0
    at = {n: i for i, p in enumerate(parts) for n in p}
    leave, reach = [0.0] * len(parts), [0.0] * len(parts)
    for a, b, w in flows:
        if at[a] != at[b]:
            leave[at[a]] += w
            reach[at[b]] += w
    inside = [sum(rates[n] for n in p) for p in parts]
    return x(sum(reach)) - sum(map(x, reach)) - sum(map(x, leave)) + sum(x(q + p) for q, p in zip(leave, inside)) - sum(x(p) for p in rates.values())


PLANTED = clique("abcd") + clique("efgh") + clique("ijkl") + [("d", "e"), ("h", "i"), ("l", "a")]
SMALL = [clique("abcd") + clique("efgh") + [("d", "e"), ("e", "d")], [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "f"), ("f", "d"), ("c", "d"), ("g", "a"), ("g", "h"), ("h", "g")]]


def test_planted_groups_are_found(spark):
    n, e = graph_of(spark, PLANTED, more=["z"])
    for made in (communities.map_communities, communities.modularity_communities):
        assert groups(made(n, e)[0]) == [frozenset("abcd"), frozenset("efgh"), frozenset("ijkl"), frozenset("z")]


@pytest.mark.parametrize("pairs", SMALL)
def test_codelength_is_no_worse_than_the_best_of_all_partitions(spark, pairs):
    n, e = graph_of(spark, pairs)
    labels, bits = communities.map_communities(n, e, tolerance=0.0)
    ground = communities.flow_level(*communities.known_edges(n, e), 0.15, 40)
    rates = {r.id: r.mass for r in ground.nodes.collect()}
    flows = [tuple(r) for r in ground.links.select("a", "b", "w").collect()]
    assert bits == pytest.approx(codelength(rates, flows, groups(labels)), abs=1e-9)
    assert bits <= min(codelength(rates, flows, p) for p in partitions(sorted(rates))) + 1e-9


def test_modularity_equals_sql_and_communities_are_connected(spark):
    bridges = [("a", "x"), ("x", "b"), ("x", "y"), ("y", "e"), ("a", "a"), ("y", "i")]
    n, e = graph_of(spark, PLANTED + bridges)
    labels, q = communities.modularity_communities(n, e, tolerance=0.0)
    c = duckdb.connect()
    c.register("labels", labels.toPandas())
    c.register("edges", e.distinct().toPandas())
    want = c.sql("""
WITH m AS (SELECT count(*)::DOUBLE AS m FROM edges), o AS (SELECT community_id AS c, count(*) AS k FROM edges JOIN labels ON source_id = node_id GROUP BY 1),
i AS (SELECT community_id AS c, count(*) AS k FROM edges JOIN labels ON target_id = node_id GROUP BY 1),
s AS (SELECT count(*) AS inner_ FROM edges JOIN labels a ON source_id = a.node_id JOIN labels b ON target_id = b.node_id WHERE a.community_id = b.community_id)
SELECT (SELECT inner_ FROM s) / m - (SELECT sum(o.k * i.k) FROM o JOIN i USING (c)) / (m * m) FROM m""").fetchall()[0][0]
    assert q == pytest.approx(want, abs=1e-12) and q > 0.4
    inner = e.join(labels.withColumnRenamed("node_id", "source_id").withColumnRenamed("community_id", "x"), "source_id").join(labels.withColumnRenamed("node_id", "target_id").withColumnRenamed("community_id", "y"), "target_id").where("x = y")
    parts = components(n, inner.select("source_id", "target_id"))
    assert parts.join(labels, "node_id").groupBy("community_id").agg({"component": "count"}).count() == parts.select("component").distinct().count()


def test_report_flags_and_unknown_ends(spark):
    n, e = graph_of(spark, SMALL[0])
    e = e.union(spark.createDataFrame([("a", "nobody")], EDGES))
    got = communities.detected(n, e, least=3, most=1)
    report = got["report"].first()
    assert report.community_count == 2 and report.flags == ["community_count_below_minimum", "community_count_above_maximum"] and report.algorithm == "map_equation"
    assert [r.node_id for r in got["warnings"].collect()] == ["nobody"]
    nothing = communities.detected(n.limit(0), e)
    assert nothing["communities"].count() == 0 and nothing["report"].first().community_count == 0


def test_packed_links_lose_nothing_and_totals_equal_plain_sums(spark):
    """A hub's links are several rows; what leaves and reaches a module is counted from them."""
    pairs = [("h", f"n{i:02d}") for i in range(40)] + [("n01", "h"), ("n02", "n03"), ("n03", "n02")]
    n, e = graph_of(spark, pairs)
    rows = packed(e, "source_id", "targets", most=8).collect()
    assert sorted((r.source_id, x.target_id) for r in rows for x in r.targets) == sorted(pairs)
    assert sum(r.source_id == "h" for r in rows) > 1 and max(len(r.targets) for r in rows) < 40
    names, ids, links = communities.counted(n, e)
    assert [r.name for r in names.orderBy("node_id").collect()] == sorted({x for p in pairs for x in p})
    level = communities.flow_level(ids, links, 0.15, 40)
    labels = ids.selectExpr("node_id AS id", "node_id % 3 AS module")
    flows = [tuple(r) for r in level.links.select("a", "b", "w").collect()]
    got = {r.module: r for r in level.totals(labels).collect()}
    for m in range(3):
        assert got[m].exit == pytest.approx(sum(w for a, b, w in flows if a % 3 == m != b % 3), abs=1e-12)
        assert got[m].enter == pytest.approx(sum(w for a, b, w in flows if b % 3 == m != a % 3), abs=1e-12)
