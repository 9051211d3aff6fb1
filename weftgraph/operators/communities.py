"""Communities of a directed citation graph: by the map equation, or by modularity with refinement.

Both lower an objective by moving nodes between modules, then take the modules for nodes and go on, level by level. A round
of moves is one shuffle of the links: nodes send their module and its totals to their neighbours, where they are grouped to flows between a node
and a module. Nodes are numbered for this, in the order of their names. Each node's best move is kept, and a part of them, dealt by a seeded hash, is made at once. Moves that were each good alone can be bad together, so a
round counts only if the objective fell; if not, fewer moves are made, at last the best one alone, whose gain is exact. Labels, moves and
totals of every round are written tables, and only sums and counts come to the driver.

Edge cases: edges with an endpoint that is no node are left out, and ``unknown`` gives their ends; parallel edges count once;
self-loops and isolated nodes take part (an isolated node is a community of its own); no nodes give no labels.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from weftgraph.operators.graph import communities as label_propagation
from weftgraph.operators.graph import components, packed, pagerank, unknown_endpoints
from weftgraph.sources.store import cut, placed

#: The least gain that counts.
LEAST = 1e-12


def plogp(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))


@dataclass
class Level:
    """nodes: id, mass, out, in (flow over links to and from others), kout, kin (all its weight); links: a, b, w between different nodes.

    ``near`` has the links by node, both ways, as arrays (other, to, fro: what the node sends to and gets from a neighbour). A pass over all
    links joins these few rows to labels, then sends each neighbour a row, so links move once and unsorted.
    """

    nodes: DataFrame
    links: DataFrame

    @cached_property
    def near(self) -> DataFrame:
        none = F.lit(0.0)
        both = self.links.select(F.col("a").alias("id"), F.col("b").alias("other"), F.col("w").alias("to"), none.alias("fro"))
        both = both.unionAll(self.links.select(F.col("b").alias("id"), F.col("a").alias("other"), none.alias("to"), F.col("w").alias("fro")))
        return cut(packed(both.repartition("id").groupBy("id", "other").agg(F.sum("to").alias("to"), F.sum("fro").alias("fro")), "id", "near"))

    def ends(self, labels: DataFrame) -> DataFrame:
        """a, b, w, ma, mb: the links with the labels of both ends."""
        sent = self.near.join(labels, "id").select(F.col("id").alias("a"), F.col("module").alias("ma"), F.explode("near").alias("x")).where("x.to > 0")
        return sent.select("a", "ma", F.col("x.other").alias("b"), F.col("x.to").alias("w")).join(labels.select(F.col("id").alias("b"), F.col("module").alias("mb")), "b").select("a", "b", "w", "ma", "mb")

    def totals(self, labels: DataFrame) -> DataFrame:
        """module, mass, kout, kin, and exit and enter: the flow over links that leave and reach it, which is its nodes' without what stays inside."""
        inside = self.ends(labels).where("ma = mb").groupBy(F.col("ma").alias("module")).agg(F.sum("w").alias("inside"))
        own = self.nodes.join(labels, "id").select("module", "mass", "kout", "kin", "out", "in", F.lit(0.0).alias("inside"))
        kept = inside.select("module", *[F.lit(0.0).alias(c) for c in ("mass", "kout", "kin", "out", "in")], "inside")
        sums = own.unionAll(kept).groupBy("module").agg(*[F.sum(c).alias(c) for c in ("mass", "kout", "kin", "out", "in", "inside")])
        # Sums in another order leave a rest where nothing leaves.
        over = lambda c: F.when(F.col(c) - F.col("inside") > LEAST * F.col(c), F.col(c) - F.col("inside")).otherwise(F.lit(0.0))
        return sums.select("module", "mass", "kout", "kin", over("out").alias("exit"), over("in").alias("enter"))

    def coarser(self, labels: DataFrame) -> Level:
        """The modules as nodes."""
        nodes = self.totals(labels).select(F.col("module").alias("id"), "mass", F.col("exit").alias("out"), F.col("enter").alias("in"), "kout", "kin")
        links = self.ends(labels).where("ma <> mb").groupBy(F.col("ma").alias("x"), F.col("mb").alias("y")).agg(F.sum("w").alias("w"))
        return Level(cut(nodes), cut(links.select(F.col("x").alias("a"), F.col("y").alias("b"), "w")))

    def within(self, labels: DataFrame) -> Level:
        """The same nodes with only the links inside modules."""
        return Level(self.nodes, cut(self.ends(labels).where("ma = mb").select("a", "b", "w")))


class MapEquation:
    """The codelength in bits of a walk over the links, by Rosvall and Bergstrom's two-level map equation.

    Nodes are visited as PageRank says; teleports aren't coded as leaving a module.
    """

    #: What ``change`` reads of a module's totals.
    needs = ("mass", "exit", "enter")

    def __init__(self, nodes: DataFrame):
        self.rest = nodes.agg(F.coalesce(F.sum(plogp(F.col("mass"))), F.lit(0.0))).first()[0]

    def sums(self) -> dict[str, Column]:
        return {"enter": F.sum("enter"), "index": F.sum(plogp(F.col("enter"))), "ends": F.sum(plogp(F.col("exit"))), "inside": F.sum(plogp(F.col("exit") + F.col("mass")))}

    def value(self, s: dict) -> float:
        import math

        e = s["enter"] or 0.0
        return (e * math.log2(e) if e > 0 else 0.0) - s["index"] - s["ends"] + s["inside"] - self.rest

    def change(self, s: dict) -> Column:
        """What a move of node n from module i to j adds, given its flows to and from both."""
        c = F.col
        pos = lambda x: F.greatest(x, F.lit(0.0))
        exit_i, enter_i = pos(c("i_exit") - (c("out") - c("i_to")) + c("i_fro")), pos(c("i_enter") - (c("in") - c("i_fro")) + c("i_to"))
        exit_j, enter_j = pos(c("j_exit") + (c("out") - c("j_to")) - c("j_fro")), pos(c("j_enter") + (c("in") - c("j_fro")) - c("j_to"))
        total = F.lit(float(s["enter"]))
        after = plogp(pos(total - c("i_enter") - c("j_enter") + enter_i + enter_j)) - plogp(total)
        index = plogp(enter_i) + plogp(enter_j) - plogp(c("i_enter")) - plogp(c("j_enter"))
        ends = plogp(exit_i) + plogp(exit_j) - plogp(c("i_exit")) - plogp(c("j_exit"))
        inside = plogp(exit_i + pos(c("i_mass") - c("mass"))) + plogp(exit_j + c("j_mass") + c("mass")) - plogp(c("i_exit") + c("i_mass")) - plogp(c("j_exit") + c("j_mass"))
        return after - index - ends + inside


class Modularity:
    """Directed modularity, negative, so that less is better. ``m``: the weight of all edges."""

    needs = ("kout", "kin")

    def __init__(self, m: float):
        self.m = m

    def sums(self) -> dict[str, Column]:
        return {"cross": F.sum("exit"), "chance": F.sum(F.col("kout") * F.col("kin"))}

    def value(self, s: dict) -> float:
        return -((self.m - s["cross"]) / self.m - s["chance"] / self.m**2) if self.m else 0.0

    def change(self, s: dict) -> Column:
        c, m = F.col, self.m
        links = c("j_to") + c("j_fro") - c("i_to") - c("i_fro")
        chance = c("kout") * c("j_kin") + c("kin") * c("j_kout") - c("kout") * (c("i_kin") - c("kin")) - c("kin") * (c("i_kout") - c("kout"))
        return -(links / m - chance / m**2)


def measured(level: Level, labels: DataFrame, goal) -> tuple[DataFrame, dict]:
    """The modules' totals as a written table, with the sums that the goal needs."""
    seen = Observation()
    table = cut(level.totals(labels).observe(seen, *[F.coalesce(x, F.lit(0.0)).alias(n) for n, x in goal.sums().items()]))
    return table, seen.get


def best_moves(level: Level, labels: DataFrame, totals: DataFrame, sums: dict, goal, seed: int) -> tuple[DataFrame, int]:
    """id, module, change: the best move of each node that has a good one; and their number.

    Each node tells its neighbours its module with the module's totals, so a node's options meet in one shuffle.
    """
    known = labels.join(totals.select("module", *goal.needs), "module")
    told = level.near.join(known.select("id", "module", *[F.col(x).alias(f"j_{x}") for x in goal.needs]), "id").drop("id").withColumn("x", F.explode("near"))
    told = told.select(F.col("x.other").alias("id"), "module", F.col("x.fro").alias("j_to"), F.col("x.to").alias("j_fro"), *[f"j_{x}" for x in goal.needs]).repartition("id")
    flows = told.groupBy("id", "module").agg(F.sum("j_to").alias("j_to"), F.sum("j_fro").alias("j_fro"), *[F.first(f"j_{x}").alias(f"j_{x}") for x in goal.needs])
    one = level.nodes.join(known.select("id", F.col("module").alias("home"), *[F.col(x).alias(f"i_{x}") for x in goal.needs]), "id")
    own = lambda x: F.coalesce(F.max(F.when(F.col("module") == F.col("home"), F.col(f"j_{x}"))).over(Window.partitionBy("id")), F.lit(0.0)).alias(f"i_{x}")
    options = flows.join(one, "id").select("*", own("to"), own("fro")).where("module <> home")
    options = options.select("id", "module", goal.change(sums).alias("change")).where(F.col("change") < -LEAST)
    seen = Observation()
    best = options.groupBy("id").agg(F.min(F.struct("change", F.xxhash64("module", F.lit(seed)).alias("tie"), "module")).alias("x")).select("id", "x.module", "x.change")
    moves = cut(best.observe(seen, F.count(F.lit(1)).alias("n")))
    return moves, seen.get["n"]


def settled(level: Level, labels: DataFrame, goal, seed: int, rounds: int, tolerance: float) -> tuple[DataFrame, float, bool]:
    """Labels after rounds of moves, the goal's value, and whether anything moved."""
    totals, sums = measured(level, labels, goal)
    value, moved, share = goal.value(sums), False, 0.5
    for r in range(rounds):
        moves, n = best_moves(level, labels, totals, sums, goal, seed + r)
        if not n:
            break
        while True:
            alone = n * share < 2
            some = moves.orderBy("change", "id").limit(1) if alone else moves.where(F.pmod(F.xxhash64("id", F.lit(seed * 1009 + r)), F.lit(1 << 20)) < int(share * (1 << 20)))
            new = cut(labels.join(some.select("id", F.col("module").alias("to")), "id", "left").select("id", F.coalesce("to", "module").alias("module")))
            new_totals, new_sums = measured(level, new, goal)
            fresh = goal.value(new_sums)
            if fresh < value - LEAST or alone:
                break
            share /= 4
        if fresh >= value - LEAST:
            break
        gain, value, labels, totals, sums, moved = value - fresh, fresh, new, new_totals, new_sums, True
        share = min(0.5, share * 2)
        if gain < tolerance * abs(value) and n * share >= 2:
            break
    return labels, value, moved


def composed(labels: DataFrame, upper: DataFrame) -> DataFrame:
    """The labels of nodes by those of their modules."""
    return cut(labels.select("id", F.col("module").alias("at")).join(upper.select(F.col("id").alias("at"), "module"), "at").select("id", "module"))


def alone(nodes: DataFrame) -> DataFrame:
    return cut(nodes.select("id", F.col("id").alias("module")))


def pieces(labels: DataFrame, level: Level) -> DataFrame:
    """The labels with modules cut into their connected parts."""
    inner = level.within(labels).links.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"))
    return components(labels.select(F.col("id").alias("node_id")), inner).select(F.col("node_id").alias("id"), F.col("component").alias("module"))


def climbed(ground: Level, goal, seed: int, rounds: int, levels: int, tolerance: float, refine: bool) -> tuple[DataFrame, float]:
    """Labels of the ground level's nodes by moves on ever coarser levels.

    With ``refine``, what goes up are connected parts of the modules that moves inside each module made, and they start in their module.
    """
    labels, value, _ = settled(ground, alone(ground.nodes), goal, seed, rounds, tolerance)
    level, down, own = ground, None, labels  # down: ground nodes to this level's; own: this level's labels
    for _ in range(levels):
        if refine:
            inner = level.within(own)
            fine = cut(pieces(settled(inner, alone(level.nodes), goal, seed + 7, max(2, rounds // 3), tolerance)[0], inner))
            start = fine.join(own.select("id", F.col("module").alias("community")), "id").groupBy(F.col("module").alias("id")).agg(F.min("community").alias("module"))
            start = cut(start)
        else:
            fine, start = own, None
        up = level.coarser(fine)
        down = fine if down is None else composed(down, fine)
        own, fresh, moved = settled(up, alone(up.nodes) if start is None else start, goal, seed + 13, rounds, tolerance)
        level = up
        if not moved or value - fresh <= tolerance * abs(value):
            labels = composed(down, own)
            value = min(value, fresh)
            break
        labels, value = composed(down, own), fresh
    return labels, value


def known_edges(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = cut(nodes.select("node_id").distinct())
    e = edges.select("source_id", "target_id").distinct()
    return ids, cut(e.join(ids, e.source_id == ids.node_id, "left_semi").join(ids, e.target_id == ids.node_id, "left_semi"))


def flow_level(ids: DataFrame, e: DataFrame, teleport: float, ranks: int) -> Level:
    """Visit rates by PageRank, and the flow over each link: a node's rate times what doesn't teleport, dealt evenly."""
    rate = cut(pagerank(ids, e, damping=1 - teleport, rounds=ranks))
    degree = e.groupBy("source_id").agg(F.count("*").alias("degree"))
    w = e.join(degree, "source_id").join(rate, F.col("source_id") == F.col("node_id"))
    links = cut(w.where("source_id <> target_id").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), (F.lit(1 - teleport) * F.col("pagerank") / F.col("degree")).alias("w")))
    return Level(cut(ground_nodes(rate.select(F.col("node_id").alias("id"), F.col("pagerank").alias("mass")), links, None)), links)


def ground_nodes(nodes: DataFrame, links: DataFrame, weights: DataFrame | None) -> DataFrame:
    """Nodes (id, mass) with their flows over links, and their whole weight by ``weights`` (a, b, w)."""
    def side(t, end, name):
        return t.groupBy(F.col(end).alias("id")).agg(F.sum("w").alias(name))

    for t, names in ((links, ("out", "in")), (links if weights is None else weights, ("kout", "kin"))):
        for end, name in zip("ab", names):
            nodes = nodes.join(side(t, end, name), "id", "left")
    return nodes.fillna(0.0, ["out", "in", "kout", "kin"])


def counted(ids: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Names (name, node_id) with numbers for nodes in the order of their names, and nodes and edges by number."""
    one = ids.select(F.col("node_id").alias("name"), F.lit(0).alias("all"))
    names = cut(placed(one, "all", [F.col("name")]).select("name", F.col("idx").alias("node_id")))
    at = lambda end: names.select(F.col("name").alias(f"{end}_id"), F.col("node_id").alias(end))
    return names, names.select("node_id"), cut(e.join(at("source"), "source_id").join(at("target"), "target_id").select(F.col("source").alias("source_id"), F.col("target").alias("target_id")))


def labelled(labels: DataFrame, names: DataFrame) -> DataFrame:
    """node_id, community_id: communities by their least member."""
    named = labels.join(names.select(F.col("node_id").alias("id"), "name"), "id")
    least = named.groupBy("module").agg(F.min("name").alias("community_id"))
    return named.join(least, "module").select(F.col("name").alias("node_id"), "community_id")


def map_communities(nodes: DataFrame, edges: DataFrame, seed: int = 42, trials: int = 1, teleport: float = 0.15, rounds: int = 12, levels: int = 6, tolerance: float = 1e-3, ranks: int = 40) -> tuple[DataFrame, float]:
    """node_id, community_id by the map equation, and the codelength in bits: the best of ``trials`` seeds."""
    ids, e = known_edges(nodes, edges)
    if not ids.limit(1).count():
        return ids.select("node_id", F.col("node_id").alias("community_id")), 0.0
    names, ids, e = counted(ids, e)
    ground = flow_level(ids, e, teleport, ranks)
    goal, found = MapEquation(ground.nodes), None
    whole = cut(ground.nodes.select("id", F.lit(0).cast("long").alias("module")))  # one module for all is the bound to beat
    for t in range(trials):
        labels, _ = climbed(ground, goal, seed + t, rounds, levels, tolerance, refine=False)
        labels, value, _ = settled(ground, labels, goal, seed + t, rounds, tolerance)  # nodes alone once more
        if found is None or value < found[1] - LEAST:
            found = labels, value
    one = goal.value(measured(ground, whole, goal)[1])
    found = (whole, one) if one < found[1] - LEAST else found
    return labelled(found[0], names), found[1]


def modularity_communities(nodes: DataFrame, edges: DataFrame, seed: int = 42, rounds: int = 12, levels: int = 6, tolerance: float = 1e-3) -> tuple[DataFrame, float]:
    """node_id, community_id by directed modularity, and the modularity. Refined on every level, so every community is connected."""
    ids, e = known_edges(nodes, edges)
    m = float(e.count())
    if not m:
        return ids.select("node_id", F.col("node_id").alias("community_id")), 0.0
    names, ids, e = counted(ids, e)
    weights = e.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.lit(1.0).alias("w"))
    links = cut(weights.where("a <> b"))
    ground = Level(cut(ground_nodes(ids.select(F.col("node_id").alias("id"), F.lit(0.0).alias("mass")), links, weights)), links)
    goal = Modularity(m)
    labels, _ = climbed(ground, goal, seed, rounds, levels, tolerance, refine=True)
    labels = cut(pieces(labels, ground))  # parts without a link between them lose nothing by standing apart
    return labelled(labels, names), -goal.value(measured(ground, labels, goal)[1])


def detected(nodes: DataFrame, edges: DataFrame, algorithm: str = "map_equation", least: int = 1, most: int | None = None, **options) -> dict[str, DataFrame]:
    """communities (node_id, community_id), report (algorithm, community_count, score, flags) and warnings (ends of edges that are no nodes).

    ``algorithm`` is map_equation, modularity, or label_propagation, which is cheapest and has no score. Flags tell of fewer communities
    than ``least`` or more than ``most``.
    """
    made = {"map_equation": map_communities, "modularity": modularity_communities, "label_propagation": lambda *a, **o: (label_propagation(*a, **o), None)}[algorithm]
    labels, score = made(nodes, edges, **options)
    labels = cut(labels)
    n = F.count_distinct("community_id")
    low = F.when(F.col("community_count") < least, "community_count_below_minimum")
    high = F.when(F.col("community_count") > (most if most is not None else 1 << 62), "community_count_above_maximum")
    report = labels.agg(n.alias("community_count")).select(F.lit(algorithm).alias("algorithm"), "community_count", F.lit(score).cast("double").alias("score"), F.array_compact(F.array(low, high)).alias("flags"))
    return {"communities": labels, "report": report, "warnings": unknown_endpoints(edges, nodes)}
