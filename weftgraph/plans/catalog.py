"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions import scalars
from weftgraph.operators import communities as grouping
from weftgraph.operators import cycles, graph, order, traversal
from weftgraph.plans import model
from weftgraph.sources import corpus
from weftgraph.sources import works as works_source
from weftgraph.sources.store import address_of, cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

V1 = "v1 AS (SELECT DISTINCT 'order:' || l_orderkey AS source_id, 'part:' || l_partkey AS target_id, year(o_orderdate)::INT AS y, l_partkey AS pk, l_orderkey AS ok FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
V2 = "v2 AS (SELECT DISTINCT printf('part:%06d', a.l_partkey) AS source_id, printf('part:%06d', b.l_partkey) AS target_id FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey > b.l_partkey)"
V4 = "v4 AS (SELECT 'supplier:' || s_suppkey AS source_id, 'nation:' || s_nationkey AS target_id FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("cocitation_top", f"""
WITH {V1}, p AS (SELECT a.target_id AS source_id, b.target_id AS target_id, count(*) AS strength FROM v1 a JOIN v1 b ON a.source_id = b.source_id AND a.target_id < b.target_id GROUP BY ALL)
SELECT * FROM p WHERE strength >= 2 ORDER BY strength DESC, source_id, target_id LIMIT 100""")  # fmt: skip
def cocitation_top(spark, d):
    return graph.cocitation(corpus.order_part(spark, d), max_edges=100)


@query("cocitation_all", f"""
WITH {V1} SELECT a.target_id AS source_id, b.target_id AS target_id, count(*) AS strength FROM v1 a JOIN v1 b ON a.source_id = b.source_id AND a.target_id < b.target_id GROUP BY ALL HAVING count(*) >= 2""")  # fmt: skip
def cocitation_all(spark, d):
    return graph.cocitation(corpus.order_part(spark, d))


@query("cocitation_unknown_endpoints", f"WITH {V1} SELECT DISTINCT source_id AS node_id FROM v1 JOIN orders ON o_orderkey = ok WHERE o_orderstatus <> 'F'")
def cocitation_unknown(spark, d):
    """Known are all parts and the finished orders."""
    parts = table(spark, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("node_id"))
    known = parts.union(table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("order:"), "o_orderkey")))
    return graph.unknown_endpoints(corpus.order_part(spark, d), known)


def _suppliers(spark, d):
    return table(spark, d, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("node_id"))


@query("backward_two_hop", f"""
WITH {V4}, s AS (SELECT 'supplier:' || s_suppkey AS node_id FROM supplier),
h1 AS (SELECT DISTINCT target_id AS node_id, s.node_id AS root, 1 AS hop FROM s JOIN v4 ON source_id = s.node_id),
h2 AS (SELECT DISTINCT target_id AS node_id, root, 2 AS hop FROM h1 JOIN v4 ON source_id = h1.node_id),
u AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2)
SELECT node_id, min(hop)::INT AS hop_depth, string_agg(DISTINCT root, ',' ORDER BY root) AS roots FROM u WHERE node_id NOT IN (SELECT node_id FROM s) GROUP BY node_id""")  # fmt: skip
def backward_two_hop(spark, d):
    rows = graph.backward(_suppliers(spark, d), corpus.supplier_tree(spark, d))
    return rows.select("node_id", "hop_depth", F.array_join("root_ids", ",").alias("roots"))


def _parts(spark, d):
    return table(spark, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("node_id"))


def _cited_parts(spark, d):
    e = corpus.order_part(spark, d)
    return e.groupBy(F.col("target_id").alias("node_id")).agg(F.count("*").alias("citation_count"), F.min("citing_paper_year").alias("year"))


@query("backward_score", f"""
WITH {V1}, p AS (SELECT target_id AS node_id, count(*) AS c, min(y) AS year FROM v1 GROUP BY 1),
r AS (SELECT node_id, c, c * ln(2.0) / exp(greatest(0, 2001 - year) * 0.1) AS x FROM p)
SELECT node_id, c AS citation_count, round(x, 9) AS score FROM r ORDER BY x DESC, node_id LIMIT 200""")  # fmt: skip
def backward_score(spark, d):
    score = scalars.backward_score(F.col("citation_count"), F.lit(1), F.col("year"), 2001, 0.1)
    return graph.top(_cited_parts(spark, d), score, 200).select("node_id", "citation_count", F.round("score", 9).alias("score"))


@query("forward_citers_ranked", f"""
WITH {V1}, r AS (SELECT target_id AS seed, source_id, y, row_number() OVER (PARTITION BY target_id ORDER BY y DESC, source_id) AS place, count(*) OVER (PARTITION BY target_id) AS total FROM v1)
SELECT seed, source_id, y AS citing_paper_year, place::INT AS place, total FROM r WHERE place <= 10""")  # fmt: skip
def forward_citers(spark, d):
    got = graph.citers(_parts(spark, d), corpus.order_part(spark, d), [F.desc("citing_paper_year"), F.col("source_id")], page=10)
    return got.select("seed", "source_id", "citing_paper_year", "place", "total")


@query("forward_truncation", f"WITH {V1} SELECT target_id AS seed, least(count(*), 10) AS returned, count(*) AS total FROM v1 GROUP BY 1 HAVING count(*) > 10")
def forward_truncation(spark, d):
    got = graph.citers(_parts(spark, d), corpus.order_part(spark, d), [F.col("source_id")], page=10)
    return got.groupBy("seed").agg(F.count("*").alias("returned"), F.first("total").alias("total")).where("returned < total")


YEARS = "c AS (SELECT target_id AS node_id, y AS year, count(*) AS n FROM v1 GROUP BY ALL)"


def _yearly(spark, d):
    return corpus.order_part(spark, d).groupBy(F.col("target_id").alias("node_id"), F.col("citing_paper_year").alias("year")).agg(F.count("*").alias("n"))


@query("acceleration", f"""
WITH {V1}, {YEARS}, s AS (SELECT node_id, n / 12.0 - lag(n / 12.0) OVER (PARTITION BY node_id ORDER BY year) AS step, count(*) OVER (PARTITION BY node_id) AS k FROM c)
SELECT node_id, round(avg(step), 9) + 0.0 AS acceleration FROM s WHERE k >= 3 GROUP BY node_id""")  # fmt: skip
def acceleration(spark, d):
    rows = _yearly(spark, d).groupBy("node_id").agg(F.collect_list(F.struct("year", F.col("n").alias("count"))).alias("counts"))
    return rows.select("node_id", (F.round(scalars.acceleration(F.col("counts")), 9) + 0.0).alias("acceleration")).where("acceleration IS NOT NULL")


@query("forward_score", f"""
WITH {V1}, {YEARS}, s AS (SELECT node_id, year, n, n / 12.0 - lag(n / 12.0) OVER (PARTITION BY node_id ORDER BY year) AS step FROM c),
p AS (SELECT node_id, sum(n) AS c, min(year) AS year, CASE WHEN count(*) >= 3 THEN avg(step) END AS a FROM s GROUP BY 1)
SELECT node_id, round(0.7 * (c / greatest(1, (2001 - year) * 12)) + 0.3 * coalesce(a, 0) * exp((2001 - year) * 0.05), 9) AS score FROM p""")  # fmt: skip
def forward_score(spark, d):
    rows = _yearly(spark, d).groupBy("node_id").agg(F.collect_list(F.struct("year", F.col("n").alias("count"))).alias("counts"), F.sum("n").alias("c"), F.min("year").alias("year"))
    score = scalars.forward_score(F.col("c"), F.col("year"), scalars.acceleration(F.col("counts")), 2001, 0.7, 0.3, 0.05)
    return rows.select("node_id", F.round(score, 9).alias("score"))


def _two_sources(spark, d):
    """Two sources of edges for assembly: lines that were not returned, in their orders' year, and all lines, in the year first shipped."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    ends = [F.concat(F.lit("order:"), "l_orderkey").alias("source_id"), F.concat(F.lit("part:"), "l_partkey").alias("target_id"), F.lit("cites").alias("type")]
    one = li.where("l_returnflag <> 'R'").join(o, li.l_orderkey == o.o_orderkey).select(*ends, F.year("o_orderdate").alias("citing_paper_year"), F.col("l_orderkey").alias("ord")).distinct()
    two = li.groupBy("l_orderkey", "l_partkey").agg(F.min(F.year("l_shipdate")).alias("citing_paper_year")).select(*ends, "citing_paper_year", F.col("l_orderkey").alias("ord"))
    return one, two


ENDS = "'order:' || l_orderkey AS source_id, 'part:' || l_partkey AS target_id"
TWO = f"one AS (SELECT DISTINCT {ENDS}, year(o_orderdate)::INT AS y, 0 AS src FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R'), two AS (SELECT {ENDS}, min(year(l_shipdate))::INT AS y, 1 AS src FROM lineitem GROUP BY l_orderkey, l_partkey), both_ AS (SELECT * FROM one UNION ALL SELECT * FROM two)"


@query("assemble_edges", f"WITH {TWO} SELECT source_id, target_id, arg_min(y, src)::INT AS citing_paper_year, min(src)::INT AS src_rank FROM both_ GROUP BY ALL")
def assemble_edges(spark, d):
    return graph.first_seen([*_two_sources(spark, d)], ["source_id", "target_id", "type"]).select("source_id", "target_id", "citing_paper_year", "src_rank")


@query("edge_mismatches", f"WITH {TWO} SELECT b.source_id, b.target_id, a.y::INT AS kept_year, b.y::INT AS other_year FROM one a JOIN two b ON a.source_id = b.source_id AND a.target_id = b.target_id AND a.y IS DISTINCT FROM b.y")
def edge_mismatches(spark, d):
    got = graph.edge_mismatches([*_two_sources(spark, d)], ["citing_paper_year"])
    return got.select("source_id", "target_id", F.col("first_citing_paper_year").alias("kept_year"), F.col("citing_paper_year").alias("other_year"))


@query("assemble_nodes", f"WITH {TWO} SELECT target_id AS node_id, min(src)::INT AS src_rank, count(DISTINCT source_id) AS roots FROM both_ GROUP BY 1")
def assemble_nodes(spark, d):
    one, two = _two_sources(spark, d)
    rows = one.withColumn("src", F.lit(0)).unionByName(two.withColumn("src", F.lit(1)))
    return rows.groupBy(F.col("target_id").alias("node_id")).agg(F.min("src").alias("src_rank"), F.size(F.collect_set("source_id")).cast("long").alias("roots"))


@query("depth_per_root", f"""
WITH RECURSIVE {V4}, e AS (SELECT * FROM v4 UNION SELECT target_id, source_id FROM v4),
w AS (SELECT 'region:' || r_regionkey AS root, 'region:' || r_regionkey AS node_id, 0 AS depth FROM region
  UNION SELECT root, target_id, depth + 1 FROM w JOIN e ON source_id = node_id WHERE depth < 6)
SELECT root, node_id, min(depth)::INT AS depth FROM w GROUP BY ALL""")  # fmt: skip
def depth_per_root(spark, d):
    e = corpus.supplier_tree(spark, d)
    roots = table(spark, d, "region").select(F.concat(F.lit("region:"), "r_regionkey").alias("node_id"))
    return graph.distances(e.union(graph.flipped(e)), roots)


@query("directed_reach", f"""
WITH RECURSIVE {V4}, w AS (SELECT source_id AS root, target_id AS node_id FROM v4 UNION SELECT root, target_id FROM w JOIN v4 ON source_id = node_id)
SELECT root, node_id FROM w WHERE root LIKE 'supplier:%'""")  # fmt: skip
def directed_reach(spark, d):
    e = corpus.supplier_tree(spark, d)
    return graph.distances(e, _suppliers(spark, d)).where("depth > 0").select("root", "node_id")


def _pagerank_sql(rounds: int) -> str:
    steps = [f"WITH {V2}", "n AS (SELECT source_id AS node_id FROM v2 UNION SELECT target_id FROM v2)", "g AS (SELECT source_id, count(*) AS degree FROM v2 GROUP BY 1)",
             "k AS (SELECT count(*)::DOUBLE AS k FROM n)", "r0 AS (SELECT node_id, 1.0 / (SELECT k FROM k) AS x FROM n)"]
    for i in range(1, rounds + 1):
        p = f"r{i - 1}"
        steps.append(f"r{i} AS MATERIALIZED (SELECT n.node_id, 0.15 / (SELECT k FROM k) + 0.85 * (coalesce(m.got, 0) + (SELECT coalesce(sum(x), 0) FROM {p} WHERE node_id NOT IN (SELECT source_id FROM g)) / (SELECT k FROM k)) AS x "
                     f"FROM n LEFT JOIN (SELECT v2.target_id, sum(x / degree) AS got FROM v2 JOIN {p} ON v2.source_id = {p}.node_id JOIN g ON g.source_id = v2.source_id GROUP BY 1) m ON m.target_id = n.node_id)")  # fmt: skip
    return ", ".join([steps[0], *steps[1:]]) + f" SELECT node_id, round(x, 9) AS pagerank FROM r{rounds}"


def _chain_nodes(e):
    return e.select(F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct()


@query("pagerank", _pagerank_sql(10))
def pagerank(spark, d):
    e = corpus.part_chain(spark, d)
    return graph.pagerank(_chain_nodes(e), e, rounds=10, tolerance=0).select("node_id", F.round("pagerank", 9).alias("pagerank"))


@query("cycle_clean")
def cycle_clean(spark, d):
    e = corpus.part_chain(spark, d, acyclic=False)
    nodes = e.groupBy(F.col("target_id").alias("node_id")).agg(F.count("*").alias("citation_count")).join(_chain_nodes(e), "node_id", "right").fillna(0, ["citation_count"])
    kept, gone = cycles.clean_cycles(nodes, e, rings=False)
    return kept.select("source_id", "target_id", F.lit(False).alias("suppressed")).union(gone.select("source_id", "target_id", F.lit(True)))


RETURNED = "v5 AS (SELECT DISTINCT printf('part:%06d', a.l_partkey) AS source_id, printf('part:%06d', b.l_partkey) AS target_id FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'R')"


@query("strong_components", f"""
WITH RECURSIVE {RETURNED}, n AS (SELECT source_id AS x FROM v5 UNION SELECT target_id FROM v5), w AS (SELECT source_id AS a, target_id AS b FROM v5 UNION SELECT w.a, target_id FROM w JOIN v5 ON source_id = w.b),
m AS (SELECT f.a, min(f.b) AS b FROM w f JOIN w g ON g.a = f.b AND g.b = f.a GROUP BY 1)
SELECT x AS node_id, least(x, coalesce(b, x)) AS component FROM n LEFT JOIN m ON a = x""")  # fmt: skip
def strong_components(spark, d):
    """Of parts at successive returned lines of an order."""
    e = corpus.returned_chain(spark, d)
    return cycles.strong_components(_chain_nodes(e), e)


@query("communities")
def communities(spark, d):
    """Communities of the part chain by the map equation."""
    e = corpus.part_chain(spark, d)
    return grouping.map_communities(_chain_nodes(e), e, rounds=6, levels=3, tolerance=0.01)[0]


@query("communities_modularity")
def communities_modularity(spark, d):
    """The same by modularity with refinement."""
    e = corpus.part_chain(spark, d)
    return grouping.modularity_communities(_chain_nodes(e), e, rounds=6, levels=3, tolerance=0.01)[0]


@query("communities_propagated")
def communities_propagated(spark, d):
    """The same by label propagation."""
    e = corpus.part_chain(spark, d)
    return graph.communities(_chain_nodes(e), e, rounds=6)


@query("components", f"""
WITH RECURSIVE {V4}, e AS (SELECT * FROM v4 UNION SELECT target_id, source_id FROM v4),
w AS (SELECT source_id AS node_id, source_id AS seen FROM e UNION SELECT w.node_id, target_id FROM w JOIN e ON source_id = seen)
SELECT node_id, min(seen) AS component FROM w GROUP BY 1""")  # fmt: skip
def components(spark, d):
    e = corpus.supplier_tree(spark, d)
    return graph.components(_chain_nodes(e), e)


@query("enrich", f"""
WITH {V1}, {YEARS}, a AS (SELECT node_id, count(*) AS years, sum(n)::BIGINT AS cited FROM c GROUP BY 1), b AS (SELECT node_id, max(year)::INT AS last_year FROM c GROUP BY 1)
SELECT * FROM a JOIN b USING (node_id)""")  # fmt: skip
def enrich(spark, d):
    y = _yearly(spark, d)
    a = y.groupBy("node_id").agg(F.count("*").alias("years"), F.sum("n").alias("cited"))
    return graph.enrich(a, y.groupBy("node_id").agg(F.max("year").alias("last_year")))


@query("shared_foundation", """
SELECT 'part:' || l_partkey AS node_id FROM lineitem WHERE l_suppkey IN (1, 2) GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) = 2""")  # fmt: skip
def shared_foundation(spark, d):
    e = table(spark, d, "lineitem").select(F.concat(F.lit("supplier:"), "l_suppkey").alias("source_id"), F.concat(F.lit("part:"), "l_partkey").alias("target_id"))
    return graph.shared_targets(e, ["supplier:1", "supplier:2"])


@query("depth_layout", f"""
WITH RECURSIVE {V4}, e AS (SELECT * FROM v4 UNION SELECT target_id, source_id FROM v4),
w AS (SELECT 'supplier:1' AS root, 'supplier:1' AS node_id, 0 AS depth UNION SELECT 'supplier:2', 'supplier:2', 0 UNION SELECT root, target_id, depth + 1 FROM w JOIN e ON source_id = node_id WHERE depth < 12),
m AS (SELECT root, node_id, min(depth) AS depth FROM w GROUP BY ALL), far AS (SELECT max(depth) + 1 AS far FROM m),
n AS (SELECT DISTINCT source_id AS node_id FROM e),
c AS (SELECT n.node_id, coalesce(a.depth, far) AS da, coalesce(b.depth, far) AS db FROM n CROSS JOIN far LEFT JOIN m a ON a.node_id = n.node_id AND a.root = 'supplier:1' LEFT JOIN m b ON b.node_id = n.node_id AND b.root = 'supplier:2')
SELECT node_id, (db - da)::INT AS lean, (da + db)::INT AS band, (row_number() OVER (PARTITION BY da + db, db - da ORDER BY node_id) - 1)::INT AS cell, greatest(1, round(sqrt(count(*) OVER (PARTITION BY da + db, db - da))))::INT AS cols FROM c""")  # fmt: skip
def depth_layout(spark, d):
    e = corpus.supplier_tree(spark, d)
    e = e.union(graph.flipped(e))
    m = graph.distances(e, spark.createDataFrame([("supplier:1",), ("supplier:2",)], "node_id string"))
    far = m.agg((F.max("depth") + 1).alias("far"))
    c = _chain_nodes(e).join(m.groupBy("node_id").agg(F.min(F.when(F.col("root") == "supplier:1", F.col("depth"))).alias("da"), F.min(F.when(F.col("root") == "supplier:2", F.col("depth"))).alias("db")), "node_id", "left").join(F.broadcast(far))
    c = c.select("node_id", (F.coalesce("db", "far") - F.coalesce("da", "far")).alias("lean"), (F.coalesce("db", "far") + F.coalesce("da", "far")).alias("band"))
    w = Window.partitionBy("band", "lean")
    return c.select("node_id", "lean", "band", (F.row_number().over(w.orderBy("node_id")) - 1).alias("cell"), F.greatest(F.lit(1), F.round(F.sqrt(F.count("*").over(w)))).cast("int").alias("cols"))


@query("coverage_stats", f"""
WITH {V1}, {YEARS}, p AS (SELECT node_id, count(*) AS k, CASE WHEN min(year) >= 1997 THEN 'recent' WHEN min(year) >= 1996 THEN 'mid' ELSE 'early' END AS band FROM c GROUP BY 1)
SELECT coalesce(band, 'all') AS band, count(*) AS total, count(*) FILTER (WHERE k >= 3) AS covered, round(100.0 * count(*) FILTER (WHERE k >= 3) / count(*), 2)::DOUBLE AS pct, median(k)::DOUBLE AS median_points, min(k) AS least, max(k) AS most FROM p GROUP BY GROUPING SETS ((), (band))""")  # fmt: skip
def coverage_stats(spark, d):
    p = _yearly(spark, d).groupBy("node_id").agg(F.count("*").alias("k"), F.min("year").alias("y"))
    p = p.withColumn("band", F.when(F.col("y") >= 1997, "recent").when(F.col("y") >= 1996, "mid").otherwise("early"))
    ok = F.count(F.when(F.col("k") >= 3, 1))
    return p.rollup("band").agg(F.count("*").alias("total"), ok.alias("covered"), F.round(100.0 * ok / F.count("*"), 2).alias("pct"), F.median("k").alias("median_points"), F.min("k").alias("least"), F.max("k").alias("most")).withColumn("band", F.coalesce("band", F.lit("all")))


@query("coverage_verdict", f"""
WITH {V1}, {YEARS}, p AS (SELECT node_id, count(*) AS k, min(year) AS y FROM c GROUP BY 1), b AS (SELECT y, 100.0 * count(*) FILTER (WHERE k >= 3) / count(*) AS pct FROM p GROUP BY 1), a AS (SELECT 100.0 * count(*) FILTER (WHERE k >= 3) / count(*) AS pct FROM p)
SELECT CASE WHEN (SELECT pct FROM a) < 50 THEN 'RED' WHEN (SELECT min(pct) FROM b) < 30 THEN 'YELLOW' ELSE 'GREEN' END AS verdict""")  # fmt: skip
def coverage_verdict(spark, d):
    p = _yearly(spark, d).groupBy("node_id").agg(F.count("*").alias("k"), F.min("year").alias("y"))
    pct = p.rollup("y").agg((100.0 * F.count(F.when(F.col("k") >= 3, 1)) / F.count("*")).alias("pct"))
    a = pct.agg(F.max(F.when(F.col("y").isNull(), F.col("pct"))).alias("whole"), F.min(F.when(F.col("y").isNotNull(), F.col("pct"))).alias("low"))
    return a.select(F.when(F.col("whole") < 50, "RED").when(F.col("low") < 30, "YELLOW").otherwise("GREEN").alias("verdict"))


@query("overlap_report", """
WITH s AS (SELECT o_custkey AS c, l_partkey AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
a AS (SELECT p FROM s JOIN customer ON c = c_custkey WHERE c_mktsegment = 'BUILDING'), b AS (SELECT p FROM s JOIN customer ON c = c_custkey WHERE c_mktsegment = 'MACHINERY')
SELECT (SELECT count(*) FROM (SELECT p FROM a INTERSECT SELECT p FROM b)) AS shared, (SELECT count(*) FROM (SELECT p FROM a EXCEPT SELECT p FROM b)) AS only_a, (SELECT count(*) FROM (SELECT p FROM b EXCEPT SELECT p FROM a)) AS only_b,
CASE WHEN (SELECT count(*) FROM (SELECT p FROM a INTERSECT SELECT p FROM b)) >= 10 THEN 'GREEN' WHEN (SELECT count(*) FROM (SELECT p FROM a INTERSECT SELECT p FROM b)) >= 3 THEN 'YELLOW' ELSE 'RED' END AS verdict""")  # fmt: skip
def overlap_report(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment IN ('BUILDING', 'MACHINERY')").select("c_custkey", (F.col("c_mktsegment") == "BUILDING").alias("in_a"))
    s = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    sides = s.groupBy("l_partkey").agg(F.bool_or("in_a").alias("a"), F.bool_or(~F.col("in_a")).alias("b"))
    n = sides.agg(F.count_if(F.col("a") & F.col("b")).alias("shared"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("b") & ~F.col("a")).alias("only_b"))
    return n.withColumn("verdict", F.when(F.col("shared") >= 10, "GREEN").when(F.col("shared") >= 3, "YELLOW").otherwise("RED"))


@query("node_id", """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'arxiv:' || regexp_extract(rtrim(url, '/'), '[^/]*$') WHEN page_id % 3 = 1 THEN 'doi:' || url ELSE 'openalex:' || regexp_extract(rtrim(url, '/'), '[^/]*$') END AS node_id FROM pages""")  # fmt: skip
def node_id(spark, d):
    p, u, m = table(spark, d, "pages"), F.col("url"), F.col("page_id") % 3
    return p.select("page_id", scalars.node_id(F.when(m == 0, u), F.when(m == 1, u).otherwise(F.lit("")), u).alias("node_id"))


@query("abstract_rebuild", r"SELECT doc_id, sha256(array_to_string(list_filter(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' '), lambda x: x <> ''), ' ')) AS abstract_sha256 FROM documents WHERE length(trim(regexp_replace(text, '\s+', ' ', 'g'))) > 0")
def abstract_rebuild(spark, d):
    w = F.filter(F.split(F.regexp_replace("text", r"\s+", " "), " "), lambda x: x != "")
    places = table(spark, d, "documents").select("doc_id", F.posexplode(w).alias("p", "w")).groupBy("doc_id", "w").agg(F.collect_list("p").alias("ps"))
    index = places.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("m"))
    return index.select("doc_id", F.sha2(scalars.abstract_text(F.col("m")), 256).alias("abstract_sha256"))


@query("text_route", "SELECT conv_id, turn, CASE WHEN trim(role) = '' AND trim(text) = '' THEN 'no_text' ELSE 'classify' END AS route FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN ' ' ELSE role END AS role, CASE WHEN turn % 4 = 0 THEN '' ELSE text END AS text FROM conversations)")
def text_route(spark, d):
    t = F.col("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", scalars.text_route(F.when(t % 2 == 0, " \t").otherwise(F.col("role")), F.when(t % 4 == 0, "").otherwise(F.col("text"))).alias("route"))


@query("keyword_eval", "SELECT doc_id, (contains(lower(text), 'the')::INT + contains(lower(text), 'and')::INT + contains(lower(text), 'des')::INT + contains(lower(text), 'der')::INT) / 4.0::DOUBLE AS score FROM documents")
def keyword_eval(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.keyword_share(F.col("text"), ["The", "and", "des", "DER"]).alias("score"))


@query("fence_strip", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN trim(text) ELSE text END AS body FROM (SELECT item_id, replace(text, chr(10), ' ') AS text FROM benchmark)")
def fence_strip(spark, d):
    t = F.regexp_replace("text", "\n", " ")
    return table(spark, d, "benchmark").select("item_id", scalars.without_fence(F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("```json\n"), t, F.lit("\n```"))).otherwise(t)).alias("body"))


@query("content_hash", "SELECT o_custkey AS custkey, sha256(string_agg(DISTINCT o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR)) AS address FROM orders GROUP BY 1")
def content_hash(spark, d):
    ids = F.array_sort(F.collect_set(F.col("o_orderkey").cast("string")))
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.sha2(F.array_join(ids, ","), 256).alias("address"))


@query("manifest_diff", """
WITH a AS (SELECT l_partkey AS k, min(l_shipdate::DATE)::VARCHAR AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_partkey AS k, min(l_shipdate::DATE)::VARCHAR AS v FROM lineitem GROUP BY 1)
SELECT coalesce(a.k, b.k) AS module, a.v AS baseline, b.v AS live FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v OR a.k IS NULL OR b.k IS NULL""")  # fmt: skip
def manifest_diff(spark, d):
    li, first = table(spark, d, "lineitem"), F.min(F.to_date("l_shipdate")).cast("string")
    a = li.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("ka")).agg(first.alias("baseline"))
    b = li.groupBy(F.col("l_partkey").alias("kb")).agg(first.alias("live"))
    j = a.join(b, F.col("ka") == F.col("kb"), "full")
    return j.where(~F.col("baseline").eqNullSafe(F.col("live")) | F.col("ka").isNull() | F.col("kb").isNull()).select(F.coalesce("ka", "kb").alias("module"), "baseline", "live")


@query("array_assign", "SELECT r_regionkey, pos AS role, n_name AS value FROM (SELECT r_regionkey, unnest([1, 2, 3]) AS pos FROM region) JOIN (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS rn FROM nation) ON n_regionkey = r_regionkey AND rn = pos")
def array_assign(spark, d):
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("v"))
    zipped = F.arrays_zip(F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1), F.least(F.lit(3), F.size("v"))).alias("role"), F.slice("v", F.lit(1), F.least(F.lit(3), F.size("v"))).alias("value"))
    return n.select(F.col("n_regionkey").alias("r_regionkey"), F.explode(zipped).alias("z")).select("r_regionkey", F.col("z")["role"].alias("role"), F.col("z")["value"].alias("value"))


@query("token_upsert", "SELECT coalesce(b.n_nationkey, a.n_nationkey) AS key, coalesce(b.v, a.v) AS value FROM (SELECT n_nationkey, n_name AS v FROM nation) a FULL JOIN (SELECT n_nationkey, lower(n_name) AS v FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%') b ON a.n_nationkey = b.n_nationkey")
def token_upsert(spark, d):
    n = table(spark, d, "nation")
    old = n.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"), F.lit(1).alias("o"))
    r = table(spark, d, "region").where("r_name LIKE 'A%'")
    new = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi").select(F.col("n_nationkey").alias("key"), F.lower("n_name").alias("value"), F.lit(0).alias("o"))
    return old.union(new).groupBy("key").agg(F.min_by("value", "o").alias("value"))


@query("hex_colour", "SELECT p_partkey, regexp_full_match('#' || substr(md5(p_name), 1, 3 + p_size % 4), '#([0-9a-fA-F]{3}|[0-9a-fA-F]{6})') AS ok FROM part")
def hex_colour(spark, d):
    c = F.concat(F.lit("#"), F.substring(F.md5(F.col("p_name").cast("binary")), F.lit(1), 3 + F.col("p_size") % 4))
    return table(spark, d, "part").select("p_partkey", scalars.is_hex_colour(c).alias("ok"))


@query("draw_outcomes", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'extends' ELSE 'unclear' END AS outcome FROM events")
def draw_outcomes(spark, d):
    m = F.col("event_id") % 4
    draw = F.when(m == 0, F.lit('```json\n{"relationship_type": "extends", "confidence": 0.5}\n```')).when(m == 1, F.lit('["extends"]')).when(m == 2, F.lit('{"relationship_type": "extends", "confidence": 2}')).otherwise(F.lit("no json"))
    return table(spark, d, "events").select("event_id", scalars.draw_outcome(draw, ["extends", "contradicts"]).alias("outcome"))


@query("json_props", "SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY 1")
def json_props(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"))


FORWARD = """
s AS (SELECT target_id AS seed FROM v2 GROUP BY 1 ORDER BY count(*) DESC, seed LIMIT 3), k AS (SELECT target_id AS node_id, count(*) AS c FROM v2 GROUP BY 1),
n AS (SELECT source_id AS node_id FROM v2 UNION SELECT target_id FROM v2), w AS (SELECT node_id, coalesce(c, 0) AS c, 1990 + split_part(node_id, ':', 2)::INT % 10 AS y FROM n LEFT JOIN k USING (node_id))"""


def _works(spark, d):
    """Works of the part chain: cited counts, a year, and the three seeds most cited."""
    e = corpus.part_chain(spark, d)
    counts = e.groupBy(F.col("target_id").alias("node_id")).agg(F.count("*").alias("citation_count"))
    works = _chain_nodes(e).join(counts, "node_id", "left").select("node_id", F.coalesce("citation_count", F.lit(0)).alias("citation_count"), (F.lit(1990) + F.substring_index("node_id", ":", -1).cast("int") % 10).alias("year"))
    seeds = counts.orderBy(F.desc("citation_count"), "node_id").limit(3).join(works.select("node_id", "year"), "node_id").withColumn("hop_depth", F.lit(0)).withColumn("root_ids", F.array("node_id"))
    return e, works, cut(seeds)


@query("forward_edges", f"""
WITH {V2}, {FORWARD}, p AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY w.c DESC, v2.source_id) AS r FROM v2 JOIN s ON target_id = seed JOIN w ON node_id = source_id)
SELECT source_id, target_id, y::INT AS citing_paper_year FROM p WHERE r <= 10 AND source_id NOT IN (SELECT seed FROM s)""")  # fmt: skip
def forward_edges(spark, d):
    """Citers of three seeds, a page of ten of each in the order asked for."""
    e, works, seeds = _works(spark, d)
    papers, edges, _ = traversal.forward_traverse(seeds, works, e, 1000, 0.1, 1.0, 0.5, 2000, "cited_by_count:desc", page=10)
    return edges.select("source_id", "target_id", "citing_paper_year")


@query("backward_edges", f"""
WITH {V2}, {FORWARD}, a AS (SELECT DISTINCT target_id AS x FROM v2 JOIN s ON source_id = seed), b AS (SELECT x FROM a UNION SELECT target_id FROM v2 JOIN a ON source_id = x),
i AS (SELECT x FROM b UNION SELECT seed FROM s)
SELECT source_id, target_id, y::INT AS citing_paper_year FROM v2 JOIN w ON node_id = source_id WHERE (source_id IN (SELECT seed FROM s) OR source_id IN (SELECT x FROM a)) AND target_id IN (SELECT x FROM i)""")  # fmt: skip
def backward_edges(spark, d):
    """Edges of two hops of references from three seeds, with every paper reached kept."""
    e, works, seeds = _works(spark, d)
    return traversal.backward_traverse(seeds, works, e, 2**31 - 1, 0.1, 2000)[1].select("source_id", "target_id", "citing_paper_year")


@query("assembled_nodes", f"""
WITH {V2}, {FORWARD}, a AS (SELECT target_id AS x, seed FROM v2 JOIN s ON source_id = seed), b AS (SELECT x, seed, 1 AS h FROM a UNION SELECT target_id, seed, 2 FROM v2 JOIN a ON source_id = x),
f AS (SELECT source_id AS x, seed, row_number() OVER (PARTITION BY seed ORDER BY w.c DESC, source_id) AS r FROM v2 JOIN s ON target_id = seed JOIN w ON node_id = source_id),
u AS (SELECT seed AS x, seed, 0 AS h, 0 AS part FROM s UNION ALL SELECT x, seed, h, 1 FROM b WHERE x NOT IN (SELECT seed FROM s) UNION ALL SELECT x, seed, 1, 2 FROM f WHERE r <= 10 AND x NOT IN (SELECT seed FROM s)),
g AS (SELECT x, part, min(h) AS h FROM u GROUP BY ALL)
SELECT x AS node_id, (SELECT arg_min(g.h, g.part) FROM g WHERE g.x = u.x)::INT AS hop_depth, string_agg(DISTINCT seed, ',' ORDER BY seed) AS roots FROM u GROUP BY x""")  # fmt: skip
def assembled_nodes(spark, d):
    """Seeds, backward and forward papers assembled: depth of the first record, roots of all."""
    e, works, seeds = _works(spark, d)
    back = traversal.backward_traverse(seeds, works, e, 2**31 - 1, 0.1, 2000)
    forth = traversal.forward_traverse(seeds, works, e, 1000, 0.1, 1.0, 0.5, 2000, "cited_by_count:desc", page=10)[:2]
    return traversal.assemble(seeds, back, forth)[0].select("node_id", "hop_depth", F.array_join("root_ids", ",").alias("roots"))


@query("result_edges", f"""
WITH {V1}, c AS (SELECT a.target_id AS source_id, b.target_id AS target_id, count(*) AS strength FROM v1 a JOIN v1 b ON a.source_id = b.source_id AND a.target_id < b.target_id GROUP BY ALL HAVING count(*) >= 2)
SELECT source_id, target_id, 'cites' AS type, NULL::BIGINT AS strength FROM v1 UNION ALL SELECT source_id, target_id, 'co_citation', strength FROM c""")  # fmt: skip
def result_edges(spark, d):
    e = corpus.order_part(spark, d)
    return traversal.result_edges(e, graph.cocitation(e))


@query("citing_sample", """
WITH c AS (SELECT 'supplier:' || l_suppkey AS seed, 'order:' || l_orderkey || ':' || l_linenumber AS node_id, year(o_orderdate)::INT AS year, l_quantity::BIGINT AS citation_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
b AS (SELECT *, CASE WHEN 1998 - year < 2 THEN 'recent' WHEN 1998 - year < 4 THEN 'mid' ELSE 'early' END AS band FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY seed, band ORDER BY citation_count DESC, node_id) AS k FROM b)
SELECT seed, node_id, band FROM r WHERE k <= CASE band WHEN 'early' THEN 10 ELSE 20 END""")  # fmt: skip
def citing_sample(spark, d):
    """The sample by bands of years of each supplier's order lines."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    c = li.join(o, li.l_orderkey == o.o_orderkey).select(F.concat(F.lit("supplier:"), "l_suppkey").alias("seed"), F.concat(F.lit("order:"), "l_orderkey", F.lit(":"), "l_linenumber").alias("node_id"), F.year("o_orderdate").alias("year"), F.col("l_quantity").cast("long").alias("citation_count"))
    banded = c.withColumn("band", works_source.year_band(F.col("year"), 1998, 2, 4))
    return works_source.ranked_sample(banded).select("seed", "node_id", "band")


@query("community_size", f"WITH RECURSIVE {V4}, e AS (SELECT * FROM v4 UNION SELECT target_id, source_id FROM v4), w AS (SELECT source_id AS n, source_id AS seen FROM e UNION SELECT w.n, target_id FROM w JOIN e ON source_id = seen), m AS (SELECT n, min(seen) AS c FROM w GROUP BY 1) SELECT count(DISTINCT c) AS community_count, count(DISTINCT c) < 3 AS below_min, count(DISTINCT c) > 4 AS above_max FROM m")
def community_size(spark, d):
    e = corpus.supplier_tree(spark, d)
    labels = graph.components(_chain_nodes(e), e).withColumnRenamed("component", "community_id")
    return traversal.community_summary(labels, 3, 4).drop("algorithm")


ACYCLIC = f"{V2}, n AS (SELECT source_id AS node FROM v2 UNION SELECT target_id FROM v2)"


@query("plan_inventory", f"WITH {V2} SELECT target_id AS node, count(*) AS inputs, max(source_id) AS last_producer FROM v2 GROUP BY 1")
def plan_inventory(spark, d):
    """Inputs of each node of the part chain, taken as a plan kept in tables."""
    e = corpus.part_chain(spark, d)
    return e.groupBy(F.col("target_id").alias("node")).agg(F.count("*").alias("inputs"), F.max("source_id").alias("last_producer"))


@query("plan_ranks", f"""
WITH RECURSIVE {ACYCLIC}, w AS (SELECT node, 0 AS r FROM n WHERE node NOT IN (SELECT target_id FROM v2) UNION SELECT target_id, r + 1 FROM w JOIN v2 ON source_id = node)
SELECT node, max(r)::INT AS rank FROM w GROUP BY 1""")  # fmt: skip
def plan_ranks(spark, d):
    """Longest way to each node of the part chain."""
    e = corpus.part_chain(spark, d)
    return order.ranks(_chain_nodes(e), e).select(F.col("node_id").alias("node"), "rank")


@query("plan_longest_chain", f"""
WITH RECURSIVE {ACYCLIC}, w AS (SELECT node, 0 AS r FROM n WHERE node NOT IN (SELECT source_id FROM v2) UNION SELECT source_id, r + 1 FROM w JOIN v2 ON target_id = node),
b AS (SELECT node, max(r) AS behind FROM w GROUP BY 1), s AS (SELECT source_id, arg_min(target_id, struct_pack(x := -behind, y := target_id)) AS step FROM v2 JOIN b ON node = target_id GROUP BY 1),
c AS (SELECT * FROM (SELECT node, 0 AS place FROM b ORDER BY behind DESC, node LIMIT 1) UNION ALL SELECT step, place + 1 FROM c JOIN s ON source_id = node)
SELECT place::INT AS place, node FROM c""")  # fmt: skip
def plan_longest_chain(spark, d):
    """The longest chain of parts, of equals the least."""
    return order.longest_chain(corpus.part_chain(spark, d)).select("place", F.col("node_id").alias("node"))


@query("reach_counts", f"""
WITH RECURSIVE {RETURNED}, e AS (SELECT * FROM v5 WHERE source_id > target_id), n AS (SELECT source_id AS x FROM e UNION SELECT target_id FROM e),
w AS (SELECT source_id AS a, target_id AS b FROM e UNION SELECT a, target_id FROM w JOIN e ON source_id = b)
SELECT x AS node_id, count(b) AS reached FROM n LEFT JOIN w ON a = x GROUP BY 1""")  # fmt: skip
def reach_counts(spark, d):
    """Parts that each part reaches along returned lines, larger key to smaller."""
    e = corpus.returned_chain(spark, d).where("source_id > target_id")
    return order.reach_counts(_chain_nodes(e), e)


@query("reach_sketches")
def reach_sketches(spark, d):
    """The same by sketches, over the whole part chain."""
    e = corpus.part_chain(spark, d)
    return order.reach_sketches(_chain_nodes(e), e)


PROBLEMS = """
SELECT 'no order' AS problem, count(*) AS edges FROM e WHERE NOT known UNION ALL SELECT 'repeated', count(*) FROM (SELECT 1 FROM e GROUP BY source, target HAVING count(*) > 1) UNION ALL SELECT 'late', count(*) FROM e WHERE late"""


@query("plan_integrity", f"WITH e AS (SELECT l_orderkey AS source, l_partkey AS target, o_orderkey IS NOT NULL AS known, coalesce(l_shipdate < o_orderdate, FALSE) AS late FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey) {PROBLEMS}")
def plan_integrity(spark, d):
    """Edges from orders to parts with an unknown order, more than once, or shipped before the order."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    e = li.join(o, li.l_orderkey == o.o_orderkey, "left")
    flags = e.groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderkey").isNull()).alias("unknown"), F.count_if(F.coalesce(F.col("l_shipdate") < F.col("o_orderdate"), F.lit(False))).alias("late"))
    counts = flags.agg(F.sum("unknown").alias("no order"), F.count_if(F.col("n") > 1).alias("repeated"), F.sum("late").alias("late"))
    return counts.unpivot([], ["no order", "repeated", "late"], "problem", "edges")


@query("plan_address", """
SELECT o_custkey AS customer, sha256('{"parameters":{"damping":0.85},"seeds":[' || string_agg(DISTINCT '"part:' || l_partkey || '"', ',' ORDER BY '"part:' || l_partkey || '"') || ']}') AS address
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")  # fmt: skip
def plan_address(spark, d):
    """Content address of the run that each customer's parts would seed."""
    seeds = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    seeds = seeds.groupBy("o_custkey").agg(F.collect_set(F.concat(F.lit("part:"), "l_partkey")).alias("seeds"))
    return seeds.select(F.col("o_custkey").alias("customer"), address_of(F.col("seeds"), '{"damping":0.85}').alias("address"))


@query("citation_pipeline")
def citation_pipeline(spark, d):
    """The declared plan run end to end on the part chain: enriched nodes."""
    from weftgraph.plans.citation import registry
    from weftgraph.plans.runner import halted, run

    e = corpus.part_chain(spark, d)
    nodes = _chain_nodes(e)
    counts = e.groupBy(F.col("target_id").alias("node_id")).agg(F.count("*").alias("citation_count"))
    works = nodes.join(counts, "node_id", "left").select("node_id", F.coalesce("citation_count", F.lit(0)).alias("citation_count"), (F.lit(1990) + F.substring_index("node_id", ":", -1).cast("int") % 10).alias("year"))
    seeds = [r.node_id for r in works.orderBy(F.desc("citation_count"), "node_id").limit(2).collect()]
    params = {"seeds": seeds, "n_backward": 3200, "n_forward": 20, "lambda_decay": 0.1, "alpha": 1.0, "beta": 0.0, "current_year": 2000, "min_strength": 2, "damping": 0.85}
    plan = model.citation_plan(params)
    out = halted(plan, run(plan, registry(works, e), {"model_client": None}))["enrich"]["enriched_nodes"]
    return out.select("node_id", "hop_depth", "citation_count", "traversal_direction", F.round("pagerank", 9).alias("pagerank"), "community_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
