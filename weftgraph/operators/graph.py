"""Operators on citation graphs. Edges are (source_id, target_id, ...), nodes (node_id, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from weftgraph.sources.store import cut


#: References above which a citer's pairs are dealt over several tasks.
HOT_CITER = 2_000
#: Neighbours that one row holds.
PACK = 4_096


def cited_pairs(e: DataFrame, hot: int = HOT_CITER) -> DataFrame:
    """a, b: the pairs (a < b) that each citer of ``e`` (citer, a) cites, once a citer.

    A citer of up to ``hot`` references is one group of a join on the citer. One with more has its references dealt to blocks of about that
    many, and each pair of blocks is a group of its own, so that no group makes more than ``hot`` by ``hot`` pairs, whatever a citer cites.
    """
    degree = e.groupBy("citer").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    large = cut(degree.select(F.col("citer").alias("large"), F.ceil(F.col("n") / hot).cast("int").alias("blocks")))
    other = lambda t: t.select(F.col("citer").alias("c2"), F.col("a").alias("b"))
    if not large.limit(1).count():
        return e.join(other(e), (F.col("citer") == F.col("c2")) & (F.col("a") < F.col("b"))).select("a", "b")
    small = e.join(large, F.col("citer") == F.col("large"), "left_anti")
    pairs = small.join(other(small), (F.col("citer") == F.col("c2")) & (F.col("a") < F.col("b"))).select("a", "b")
    dealt = e.join(large, F.col("citer") == F.col("large")).select("citer", "a", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("across"))
    right = dealt.select(F.col("citer").alias("c2"), F.col("a").alias("b"), F.col("own").alias("across2"), F.col("across").alias("own2"))
    same = (F.col("citer") == F.col("c2")) & (F.col("own") == F.col("own2")) & (F.col("across") == F.col("across2")) & (F.col("a") < F.col("b"))
    return pairs.unionAll(dealt.join(right, same).select("a", "b"))


def packed(rows: DataFrame, key: str, name: str, most: int = PACK) -> DataFrame:
    """The key, and as the array ``name`` its rows' other columns; a key of more than ``most`` rows has several arrays of about that size.

    Joins on the key then move and sort one row a key, where the table has many.
    """
    rest = [c for c in rows.columns if c != key]
    sized = rows.withColumn("packs", F.ceil(F.count(F.lit(1)).over(Window.partitionBy(key)) / most))
    pack = F.pmod(F.xxhash64(*rest), F.col("packs")).alias("pack")
    return sized.groupBy(key, pack).agg(F.collect_list(F.struct(*rest)).alias(name)).drop("pack")


def cocitation(edges: DataFrame, nodes: DataFrame | None = None, min_strength: int = 2, max_edges: int | None = None, hot: int = HOT_CITER) -> DataFrame:
    """Pairs of nodes that the same sources cite: source_id < target_id, and strength, the number of those sources.

    The self-join is on the citer, so its cost is the sum of squared reference counts; ``cited_pairs`` tells how that of one citer is dealt out.
    """
    if min_strength < 1 or (max_edges is not None and max_edges < 0):
        raise ValueError("min_strength must be 1 or more and max_edges 0 or more")
    e = edges.where("source_id <> target_id")
    if nodes is not None:
        ids = nodes.select("node_id")
        e = e.join(ids, e.source_id == ids.node_id, "left_semi").join(ids, e.target_id == ids.node_id, "left_semi")
    e = e.select(F.col("source_id").alias("citer"), F.col("target_id").alias("a")).distinct()
    out = cited_pairs(e, hot).groupBy(F.col("a").alias("source_id"), F.col("b").alias("target_id")).agg(F.count("*").alias("strength")).where(F.col("strength") >= min_strength)
    return out if max_edges is None else out.orderBy(F.desc("strength"), "source_id", "target_id").limit(max_edges)


def unknown_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Endpoints of edges that are no nodes, once each."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct()
    return ends.join(nodes.select("node_id"), "node_id", "left_anti")


def backward(seeds: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """node_id, hop_depth (the least), root_ids (sorted): what the seeds reach along references, seeds excluded.

    A node reached at a lower depth keeps it, and gathers the roots of every path.
    """
    at = seeds.select(F.col("node_id").alias("at"), F.col("node_id").alias("root"))
    found = []
    for hop in range(1, hops + 1):
        at = at.join(edges, F.col("at") == F.col("source_id")).select(F.col("target_id").alias("at"), "root").distinct()
        found.append(at.select(F.col("at").alias("node_id"), "root", F.lit(hop).alias("hop")))
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    rows = rows.join(seeds.select("node_id"), "node_id", "left_anti")
    return rows.groupBy("node_id").agg(F.min("hop").alias("hop_depth"), F.array_sort(F.collect_set("root")).alias("root_ids"))


def top(rows: DataFrame, score: Column, n: int) -> DataFrame:
    """The n rows with the highest score, ties by node_id."""
    return rows.withColumn("score", score).orderBy(F.desc("score"), "node_id").limit(n)


def citers(seeds: DataFrame, edges: DataFrame, order: list[Column], page: int = 200) -> DataFrame:
    """The first ``page`` citing edges of each seed in the given order, with ``total``, the number there is."""
    mine = edges.join(seeds.select(F.col("node_id").alias("seed")), F.col("target_id") == F.col("seed"))
    total = mine.groupBy(F.col("seed").alias("t_seed")).agg(F.count("*").alias("total"))
    ranked = mine.withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy(*order))).where(F.col("place") <= page)
    return ranked.join(total, F.col("seed") == F.col("t_seed")).drop("t_seed")


def first_seen(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Union of the parts in order; of rows with one key the first by part, then by ``ord``."""
    rows = None
    for i, p in enumerate(parts):
        p = p.withColumn("src_rank", F.lit(i))
        rows = p if rows is None else rows.unionByName(p)
    w = Window.partitionBy(*key).orderBy("src_rank", "ord")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def edge_mismatches(parts: list[DataFrame], fields: list[str]) -> DataFrame:
    """Later edges of a key that disagree with the first in any of ``fields``, null-safely."""
    rows = None
    for i, p in enumerate(parts):
        p = p.withColumn("src_rank", F.lit(i))
        rows = p if rows is None else rows.unionByName(p)
    w = Window.partitionBy("source_id", "target_id", "type").orderBy("src_rank", "ord")
    for f in fields:
        rows = rows.withColumn(f"first_{f}", F.first(f).over(w))
    differ = F.lit(False)
    for f in fields:
        differ = differ | ~F.col(f).eqNullSafe(F.col(f"first_{f}"))
    return rows.where(differ)


def distances(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """root, node_id, depth: hops along the edges from each root. One round of joins per level, each written."""
    out = frontier = cut(roots.select(F.col("node_id").alias("root"), "node_id", F.lit(0).alias("depth")))
    depth = 0
    while True:
        depth += 1
        step = frontier.join(edges, F.col("node_id") == F.col("source_id")).select("root", F.col("target_id").alias("node_id")).distinct()
        frontier = cut(step.join(out, ["root", "node_id"], "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.limit(1).count():
            return out
        out = out.unionByName(frontier)  # levels stay the tables they were written as


def flipped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))


def depth_metrics(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node_id, hop_depth_per_root, traversal_direction.

    Depth is undirected. Direction: seed for roots; backward (forward) if every root that reaches the node does so
    along (against) the references and none the other way; mixed otherwise. Raises for a node that no root reaches.
    """
    e = cut(edges.select("source_id", "target_id").distinct())
    depth = distances(e.union(flipped(e)).distinct(), roots)
    lost = nodes.join(depth.select("node_id").distinct(), "node_id", "left_anti").select("node_id").orderBy("node_id").limit(5).collect()
    if lost:
        raise ValueError(f"no root reaches {[r.node_id for r in lost]}")
    down = distances(e, roots).where("depth > 0").select("root", "node_id", F.lit(True).alias("down"))
    up = distances(flipped(e), roots).where("depth > 0").select("root", "node_id", F.lit(True).alias("up"))
    hit = depth.join(down, ["root", "node_id"], "left").join(up, ["root", "node_id"], "left")
    both = hit.groupBy("node_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("root", "depth")))).alias("hop_depth_per_root"), F.min("depth").alias("least"),
        F.bool_and(F.coalesce("down", F.lit(False))).alias("d"), F.bool_or(F.coalesce("down", F.lit(False))).alias("any_d"),
        F.bool_and(F.coalesce("up", F.lit(False))).alias("u"), F.bool_or(F.coalesce("up", F.lit(False))).alias("any_u"),
    )
    way = F.when(F.col("least") == 0, "seed").when(F.col("d") & ~F.col("any_u"), "backward").when(F.col("u") & ~F.col("any_d"), "forward").otherwise("mixed")
    return nodes.select("node_id").join(both, "node_id").select("node_id", "hop_depth_per_root", way.alias("traversal_direction"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 60, tolerance: float = 1e-12) -> DataFrame:
    """node_id, pagerank. Uniform teleport, and uniform spread of what nodes without references hold.

    Parallel edges count once. Each round reads the edges, as arrays by source, and the written ranks once and writes new ranks; what nodes
    without references hold, and how much the ranks moved, are observed while they are written.
    """
    if not 0 <= damping <= 1:
        raise ValueError("damping must be between 0 and 1")
    e = edges.select("source_id", "target_id").distinct()
    degree = e.groupBy("source_id").agg(F.count("*").alias("degree"))
    e = cut(packed(e, "source_id", "targets"))
    base = cut(nodes.select("node_id").distinct().join(degree.select(F.col("source_id").alias("node_id"), "degree"), "node_id", "left"))
    n, ends = base.agg(F.count("*"), F.count_if(F.col("degree").isNull())).first()
    if not n:
        return nodes.select("node_id", F.lit(0.0).alias("pagerank"))
    ranks, loose = base.withColumn("pagerank", F.lit(1.0 / n)), ends / n
    for _ in range(rounds):
        sent = e.join(ranks.select("node_id", (F.col("pagerank") / F.col("degree")).alias("share")), F.col("source_id") == F.col("node_id")).select(F.explode("targets.target_id").alias("to"), "share")
        got = sent.groupBy("to").agg(F.sum("share").alias("got"))
        fresh = F.lit((1 - damping) / n) + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.lit(loose / n))
        new = ranks.join(got, F.col("node_id") == F.col("to"), "left").select("node_id", "degree", fresh.alias("pagerank"), F.abs(fresh - F.col("pagerank")).alias("moved"))
        seen = Observation()
        ranks = cut(new.observe(seen, F.coalesce(F.sum(F.when(F.col("degree").isNull(), F.col("pagerank"))), F.lit(0.0)).alias("loose"), F.sum("moved").alias("moved"))).drop("moved")
        loose = seen.get["loose"]
        if seen.get["moved"] < tolerance:
            break
    return ranks.select("node_id", "pagerank")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, component: the least node of each undirected component."""
    e = cut(packed(edges.union(flipped(edges)).distinct(), "source_id", "targets"))
    label = cut(nodes.select("node_id", F.col("node_id").alias("component")))
    while True:
        heard = e.join(label, F.col("source_id") == F.col("node_id")).select(F.explode("targets.target_id").alias("to"), "component").groupBy("to").agg(F.min("component").alias("heard"))
        new = label.join(heard, F.col("node_id") == F.col("to"), "left").select("node_id", F.col("component").alias("old"), F.least("component", "heard").alias("component"))
        up = label.select(F.col("node_id").alias("u"), F.col("component").alias("above"))
        new = cut(new.join(up, F.col("component") == F.col("u"), "left").select("node_id", "old", F.least("component", "above").alias("component")))
        if not new.where("old <> component").limit(1).count():
            return new.select("node_id", "component")
        label = new.select("node_id", "component")


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 12) -> DataFrame:
    """node_id, community_id by synchronous label propagation with damping by node order; every node gets a label.

    A node takes the label most of its neighbours have, ties to the least; half of the nodes, by hash and
    round, move in each round, so two-sided graphs settle. A self-loop is a vote for the node's own label. The
    algorithm's name is label_propagation.
    """
    e = edges.select("source_id", "target_id").distinct()
    e = cut(e.union(flipped(e)).distinct())
    label = cut(nodes.select("node_id", F.col("node_id").alias("community_id")))
    for i in range(rounds):
        votes = e.join(label, F.col("source_id") == F.col("node_id")).groupBy("target_id", "community_id").agg(F.count("*").alias("n"))
        best = votes.groupBy(F.col("target_id").alias("to")).agg(F.min_by("community_id", F.struct((-F.col("n")).alias("n"), "community_id")).alias("best"))
        moves = (F.pmod(F.xxhash64("node_id", F.lit(i)), F.lit(2)) == 0) & F.col("best").isNotNull()
        label = cut(label.join(best, F.col("node_id") == F.col("to"), "left").select("node_id", F.when(moves, F.col("best")).otherwise(F.col("community_id")).alias("community_id")))
    return label


def enrich(nodes: DataFrame, *metrics: DataFrame) -> DataFrame:
    """Nodes with the columns of every metric; raises, when read, for a node that a metric lacks."""
    for m in metrics:
        extra = [c for c in m.columns if c != "node_id"]
        joined = nodes.join(m.withColumn("has", F.lit(True)), "node_id", "left")
        ok = F.when(F.col("has").isNull(), F.raise_error(F.concat(F.lit("no metrics for "), "node_id")).cast("boolean")).otherwise(F.lit(True))
        nodes = joined.where(ok).select(*nodes.columns, *extra)
    return nodes


def shared_targets(edges: DataFrame, roots: list[str]) -> DataFrame:
    """Nodes that every one of the roots cites."""
    mine = edges.where(F.col("source_id").isin(roots))
    return mine.groupBy(F.col("target_id").alias("node_id")).agg(F.count_distinct("source_id").alias("n")).where(F.col("n") == len(set(roots))).select("node_id")
