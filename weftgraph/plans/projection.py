"""Projections for viewers: depth and provenance of a result, and the layout of a declared plan."""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators import graph
from weftgraph.plans import model

#: Margins of the drawing, size of a node in its cell, spread of its ports, decimals of a coordinate.
MARGIN_X, MARGIN_Y, NODE_W, NODE_H, SPREAD, DECIMALS = 0.06, 0.05, 0.68, 0.46, 0.74, 6


def leaned(nodes: DataFrame, a: str, b: str) -> DataFrame:
    """Nodes with depth_to_a, depth_to_b, lean (b less a) and band (their sum), from hop_depth_per_root.

    A root that does not reach a node counts as one deeper than the deepest depth seen (1 without any).
    """
    deepest = nodes.agg(F.coalesce(F.max(F.array_max(F.map_values("hop_depth_per_root"))) + 1, F.lit(1)).alias("far"))
    d = nodes.join(F.broadcast(deepest))  # one row
    da, db = (F.coalesce(F.try_element_at("hop_depth_per_root", F.lit(r)), "far") for r in (a, b))
    return d.withColumns({"depth_to_a": da, "depth_to_b": db}).drop("far").withColumns({"lean": F.col("depth_to_b") - F.col("depth_to_a"), "band": F.col("depth_to_a") + F.col("depth_to_b")})


def depth_provenance(nodes: DataFrame, edges: DataFrame, a: str, b: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes with coordinates and marks, edges, meta of one row): bands of depth from top to bottom, lean from left to right.

    In a cell, nodes stand in a grid in node_id order; a band is as high as its fullest cell needs. A single root is both.
    Rows have no order; sort by node_id, and by source, target and type, at the output.
    """
    b = b or a
    n = leaned(nodes, a, b)
    cells = n.groupBy("band", "lean").agg(F.count("*").alias("members"))
    cells = cells.withColumn("cols", F.greatest(F.lit(1), F.round(F.sqrt("members")).cast("int"))).withColumn("rows", F.ceil(F.col("members") / F.col("cols")))
    bands = cells.groupBy("band").agg(F.max("rows").alias("band_rows"))
    above = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)  # a row for each band
    total = bands.agg(F.sum("band_rows").alias("all_rows"))
    bands = bands.withColumn("rows_above", F.coalesce(F.sum("band_rows").over(above), F.lit(0))).join(F.broadcast(total)).withColumnRenamed("band", "of_band")
    span = n.agg(F.min("lean").alias("lean_min"), F.max("lean").alias("lean_max"))
    place = F.row_number().over(Window.partitionBy("band", "lean").orderBy("node_id")) - 1
    p = n.withColumn("i", place).join(cells.withColumnsRenamed({"band": "c_band", "lean": "c_lean"}), (F.col("band") == F.col("c_band")) & (F.col("lean") == F.col("c_lean"))).join(bands, F.col("band") == F.col("of_band")).join(F.broadcast(span))
    slot = F.lit(1 - 2 * MARGIN_X) / (F.col("lean_max") - F.col("lean_min") + 1)
    high = F.lit(1 - 2 * MARGIN_Y) / F.col("all_rows")
    x = MARGIN_X + (F.col("lean_max") - F.col("lean")) * slot + (F.col("i") % F.col("cols") + 0.5) / F.col("cols") * slot
    y = MARGIN_Y + F.col("rows_above") * high + (F.floor(F.col("i") / F.col("cols")) + 0.5) / F.col("rows") * high * F.col("band_rows")
    both = graph.shared_targets(edges.where("type = 'cites'"), [a, b]).select(F.col("node_id").alias("both_id"))
    way = F.col("traversal_direction")
    out = p.join(both, F.col("node_id") == F.col("both_id"), "left").select(
        *nodes.columns, "depth_to_a", "depth_to_b", F.round(x, DECIMALS).alias("x"), F.round(y, DECIMALS).alias("y"), F.coalesce(way == "seed", F.lit(False)).alias("is_seed"),
        (F.col("lean") == 0).alias("is_equidistant"), F.col("both_id").isNotNull().alias("is_cited_by_both"), F.coalesce(way.isin("forward", "mixed"), F.lit(False)).alias("lag_caveat"),
    )
    kind, strength = F.col("type"), F.when(F.col("type") == "co_citation", F.col("strength"))
    of_edges = edges.agg(F.count("*").alias("edge_count"), F.count_if(kind == "cites").alias("cites_count"), F.count_if(kind == "co_citation").alias("co_citation_count"), F.min(strength).alias("strength_min"), F.max(strength).alias("strength_max"))
    of_nodes = out.agg(
        F.count("*").alias("node_count"), F.count_if("is_cited_by_both").alias("shared_foundation_count"), F.count_if("lag_caveat").alias("lag_caveat_count"), F.array_sort(F.collect_set(F.col("depth_to_a") + F.col("depth_to_b"))).alias("depth_bands"),
        F.min(F.col("depth_to_b") - F.col("depth_to_a")).alias("lean_min"), F.max(F.col("depth_to_b") - F.col("depth_to_a")).alias("lean_max"),
    )
    ways = nodes.groupBy(F.coalesce("traversal_direction", F.lit("unknown")).alias("w")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("w", "n")))).alias("traversal_direction_counts"))
    meta = of_nodes.join(F.broadcast(of_edges)).join(F.broadcast(ways))  # one row each
    return out, edges, meta


def placed(plan: model.Plan) -> tuple[dict[str, int], dict[str, int], dict[str, float]]:
    """rank, slot and y of each plan node: the mean y of its placed predecessors orders a rank, then the id; ranks are centred."""
    rank, before = model.ranks(plan), model._neighbours(plan, False)
    rows: dict[int, list[str]] = {}
    for i, r in rank.items():
        rows.setdefault(r, []).append(i)
    step = (1 - 2 * MARGIN_Y) / max(map(len, rows.values()))
    slot, y = {}, {}
    for r in sorted(rows):
        def pull(i: str) -> float:
            near = [y[p] for p in sorted(before[i]) if p in y]
            return sum(near) / len(near) if near else 0.5

        for k, i in enumerate(sorted(rows[r], key=lambda i: (pull(i), i))):
            slot[i] = k
        y |= {i: 0.5 + (slot[i] - (len(rows[r]) - 1) / 2) * step for i in rows[r]}
    return rank, slot, y


def declared_graph(plan: model.Plan) -> dict:
    """meta, nodes and edges of a plan's layered drawing. Parameters show by name only, so their values change nothing."""
    if not plan.nodes:
        raise ValueError("the plan has no nodes")
    rank, slot, y = placed(plan)
    n_ranks, widest = len(set(rank.values())), max(Counter(rank.values()).values())
    col, row = (1 - 2 * MARGIN_X) / n_ranks, (1 - 2 * MARGIN_Y) / widest
    w, h = col * NODE_W, row * NODE_H
    x = {i: MARGIN_X + (r + 0.5) * col for i, r in rank.items()}
    r6 = lambda v: round(v, DECIMALS)

    def anchors(node: model.Node, ports: list[str] | None, side: float) -> dict[str, dict[str, float]]:
        return {p: {"x": r6(x[node.id] + side), "y": r6(y[node.id] + (k - (len(ports) - 1) / 2) * h * SPREAD / len(ports))} for k, p in enumerate(ports or [])}

    at = {n.id: {"inputs": anchors(n, n.input_ports, -w / 2), "outputs": anchors(n, n.output_ports, w / 2)} for n in plan.nodes}
    end = lambda i, side, port, off: at[i][side].get(port) or {"x": r6(x[i] + off), "y": r6(y[i])}
    nodes = [
        {"node_id": n.id, "type": n.type, "rank": rank[n.id], "slot": slot[n.id], "x": r6(x[n.id]), "y": r6(y[n.id]), "input_ports": n.input_ports, "output_ports": n.output_ports, "port_anchors": at[n.id],
         "param_keys": sorted(n.params), "resources": n.resources, "enabled_when": n.enabled_when, "disabled_passthrough": n.disabled_passthrough, "upstream_count": len(model.upstream(plan, n.id)), "downstream_count": len(model.downstream(plan, n.id))}
        for n in sorted(plan.nodes, key=lambda n: n.id)
    ]
    edges = []
    for e in sorted(plan.edges, key=lambda e: (e.source, e.target, e.from_port or "", e.to_port or "", e.type)):
        a, b = end(e.source, "outputs", e.from_port, w / 2), end(e.target, "inputs", e.to_port, -w / 2)
        edges.append({"id": f"{e.source}.{e.from_port}->{e.target}.{e.to_port}", "source_id": e.source, "target_id": e.target, "type": e.type, "from_port": e.from_port, "to_port": e.to_port, "x1": a["x"], "y1": a["y"], "x2": b["x"], "y2": b["y"], "rank_span": rank[e.target] - rank[e.source]})
    chain = model.longest_chain(plan)
    meta = {
        "view": "declared_graph", "graph_name": plan.name, "graph_version": plan.version, "node_count": len(nodes), "edge_count": len(edges), "edge_type_counts": dict(sorted(Counter(e.type for e in plan.edges).items())), "rank_count": n_ranks,
        "ranks": [sorted((i for i in rank if rank[i] == r), key=slot.get) for r in sorted(set(rank.values()))], "max_rank_size": widest, "longest_chain": chain, "longest_chain_length": len(chain), "node_size": {"w": r6(w), "h": r6(h)},
        "resource_names": sorted({r for n in plan.nodes for r in n.resources or []}), "conditional_node_count": sum(n.enabled_when is not None for n in plan.nodes),
    }
    return {"meta": meta, "nodes": nodes, "edges": edges}


def page(data: dict, title: str, script: str = "") -> str:
    """A self-contained HTML page that carries ``data`` as JSON, safe inside a script element."""
    text = json.dumps(data, sort_keys=True, ensure_ascii=False)
    for bad, good in (("<", "\\u003c"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        text = text.replace(bad, good)
    return f'<!doctype html><meta charset="utf-8"><title>{escaped(title)}</title><script type="application/json" id="data">{text}</script><script>{script}</script>'


def escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def html_escaped(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def mermaid(plan: model.Plan) -> str:
    """The plan as a flow chart; nodes and edges in declaration order."""
    lines = ["flowchart TD", *(f'    {n.id}["{n.type}"]' for n in plan.nodes)]
    return "\n".join([*lines, *dict.fromkeys(f"    {e.source} --> {e.target}" for e in plan.edges)])


def spliced(text: str, block: str, begin: str, end: str) -> str:
    """``text`` with what stands between the two marks replaced; ValueError if a mark is missing."""
    if begin not in text or end not in text.partition(begin)[2]:
        raise ValueError(f"mark {begin if begin not in text else end!r} is missing")
    head, _, rest = text.partition(begin)
    return f"{head}{begin}\n{block}\n{end}{rest.partition(end)[2]}"
