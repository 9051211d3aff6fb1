"""Declared dataflow plans: nodes with ports, edges between them, checks and queries."""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from dataclasses import asdict, dataclass, field
from typing import Any

#: Port names that the runner uses itself.
RESERVED = {"status", "node_id", "injected"}


@dataclass
class Node:
    id: str
    type: str
    params: dict[str, Any] = field(default_factory=dict)
    status: str = "PENDING"
    input_ports: list[str] | None = None
    output_ports: list[str] | None = None
    resources: list[str] | None = None
    enabled_when: str | None = None
    disabled_passthrough: dict[str, str] | None = None


@dataclass(frozen=True)
class Edge:
    source: str
    target: str
    type: str = "DATA"
    from_port: str | None = None
    to_port: str | None = None


@dataclass
class Plan:
    name: str
    nodes: list[Node]
    edges: list[Edge]
    version: str = "1"

    def node(self, node_id: str) -> Node | None:
        return next((n for n in self.nodes if n.id == node_id), None)

    def edges_from(self, node_id: str) -> list[Edge]:
        return [e for e in self.edges if e.source == node_id]

    @classmethod
    def from_dict(cls, d: dict) -> Plan:
        """ValueError names the part that is missing or unknown."""
        if not isinstance(d, dict):
            raise ValueError("a plan is a JSON object")
        try:
            return cls(d["name"], [Node(**n) for n in d["nodes"]], [Edge(**e) for e in d["edges"]], d.get("version", "1"))
        except KeyError as e:
            raise ValueError(f"the plan lacks {e}") from e
        except TypeError as e:
            raise ValueError(f"the plan has an unfit node or edge: {e}") from e

    @classmethod
    def from_json(cls, text: str) -> Plan:
        return cls.from_dict(json.loads(text))

    def to_dict(self) -> dict:
        return asdict(self)

    def update_node(self, node_id: str, params: dict[str, Any]) -> Node:
        """Merges the parameters into the node's own, without checking the plan again."""
        node = self.node(node_id)
        if node is None:
            raise ValueError(f"no node {node_id}")
        node.params |= params
        return node


def _neighbours(plan: Plan, down: bool) -> dict[str, set[str]]:
    out: dict[str, set[str]] = defaultdict(set)
    for e in plan.edges:
        a, b = (e.source, e.target) if down else (e.target, e.source)
        out[a].add(b)
    return out


def _reach(plan: Plan, node_id: str, down: bool) -> list[str]:
    near, seen, todo = _neighbours(plan, down), set(), [node_id]
    while todo:
        fresh = near[todo.pop()] - seen
        seen |= fresh
        todo += fresh
    return sorted(seen - {node_id}) if plan.node(node_id) else []


def downstream(plan: Plan, node_id: str) -> list[str]:
    return _reach(plan, node_id, True)


def upstream(plan: Plan, node_id: str) -> list[str]:
    return _reach(plan, node_id, False)


def topological(plan: Plan) -> list[str]:
    """Node ids in dependency order, declaration order among equals; ValueError on a cycle."""
    near = _neighbours(plan, True)
    left = Counter({n.id: 0 for n in plan.nodes})
    for n in plan.nodes:
        for t in near[n.id]:
            left[t] += 1
    order, place = [], {n.id: i for i, n in enumerate(plan.nodes)}
    ready = [n.id for n in plan.nodes if not left[n.id]]
    while ready:
        x = ready.pop(0)
        order.append(x)
        for t in sorted(near[x], key=lambda t: place.get(t, -1)):
            left[t] -= 1
            if not left[t] and t in place:
                ready.append(t)
    if len(order) < len(place):
        raise ValueError("the plan has a cycle")
    return order


def ranks(plan: Plan) -> dict[str, int]:
    """Length of the longest way to each node from a source."""
    near, out = _neighbours(plan, False), {}
    for x in topological(plan):
        out[x] = max((out[p] + 1 for p in near[x]), default=0)
    return out


def longest_chain(plan: Plan) -> list[str]:
    """The longest chain of nodes, the lexicographically least of equals; empty with a cycle."""
    try:
        order = topological(plan)
    except ValueError:
        return []
    near, best = _neighbours(plan, True), {}
    for x in reversed(order):
        best[x] = [x, *min((best[t] for t in near[x]), key=lambda c: (-len(c), c), default=[])]
    return min(best.values(), key=lambda c: (-len(c), c), default=[])


def summary(plan: Plan) -> dict:
    return {"name": plan.name, "nodes": len(plan.nodes), "edges": len(plan.edges), "status": dict(Counter(n.status for n in plan.nodes)), "types": dict(Counter(n.type for n in plan.nodes))}


def subgraph(plan: Plan, ids: list[str]) -> Plan:
    """The nodes named, and the edges with both ends among them."""
    kept = set(ids)
    return Plan(plan.name, [n for n in plan.nodes if n.id in kept], [e for e in plan.edges if e.source in kept and e.target in kept], plan.version)


def cycles(plan: Plan) -> list[list[str]]:
    """Every simple cycle, each from its least node on, in sorted order. Their number can grow exponentially with a plan."""
    near, out = _neighbours(plan, True), []
    for first in sorted(n.id for n in plan.nodes):
        paths = [[first]]
        while paths:
            path = paths.pop()
            for t in near[path[-1]]:
                if t == first:
                    out.append(path)
                elif t > first and t not in path:
                    paths.append([*path, t])
    return sorted(out)


#: Node types that tell what field a plan is from.
FIELDS = {
    "vfx": {"LoadAsset", "Render", "Simulate", "ApplyShader", "Cache", "Composite", "ShaderValidate", "RenderComparison", "LookApproval", "MaterialAssign"},
    "ai": {"LLMCall", "VectorRetrieve", "ToolInvoke", "Evaluator", "Router", "MemoryUpdate", "HumanInLoop"},
}


def intent(plan: Plan, ids: list[str] | None = None) -> dict:
    """What a plan or a part of it does: inventories, field, longest chain, gates and failed nodes; an error for an empty scope."""
    part = plan if ids is None else subgraph(plan, ids)
    if not part.nodes:
        return {"error": "No nodes found in scope."}
    types = Counter(n.type for n in part.nodes)
    fields = [f for f, kinds in FIELDS.items() if kinds & set(types)]
    return {
        "graph": plan.name, "scope": "full" if ids is None else "subgraph", "node_count": len(part.nodes), "edge_count": len(part.edges),
        "domain": "hybrid" if len(fields) > 1 else fields[0] if fields else "unknown", "node_types": dict(types), "status": dict(Counter(n.status for n in part.nodes)),
        "edge_types": dict(Counter(e.type for e in part.edges)), "critical_path": longest_chain(part), "control_gates": [e.source for e in part.edges if e.type == "CONTROL"],
        "failed_nodes": [n.id for n in part.nodes if n.status == "FAILED"],
    }


def producer(plan: Plan, node_id: str, port: str) -> tuple[str, str]:
    """Node and output port that the plan declares to feed an input; ValueError if none or several do."""
    found = [(e.source, e.from_port) for e in plan.edges if e.target == node_id and e.to_port == port]
    if len(found) != 1:
        raise ValueError(f"{node_id}.{port} has {len(found)} producers")
    return found[0]


def integrity(plan: Plan) -> dict:
    errors = problems(plan)
    return {"valid": not errors, "errors": errors}


def problems(plan: Plan) -> list[str]:
    """What is wrong with the plan: identities, then references, then dataflow."""
    out = [f"duplicate node id: {i}" for i, n in sorted(Counter(n.id for n in plan.nodes).items()) if n > 1]
    ids = {n.id: n for n in reversed(plan.nodes)}
    for e in plan.edges:
        out += [f"edge names missing node: {x}" for x in (e.source, e.target) if x not in ids]
    try:
        topological(plan)
    except ValueError as e:
        out.append(str(e))
    faulty: set[str] = set()
    fed: Counter = Counter()
    for e in plan.edges:
        a, b = ids.get(e.source), ids.get(e.target)
        if a is None or b is None:
            faulty.add(e.target)
            continue
        before, bound = len(out), b.input_ports is not None
        if (e.from_port is None) != (e.to_port is None):
            out.append(f"edge {e.source}->{e.target} declares one port only")
        elif e.to_port is None:
            if bound:
                out.append(f"edge {e.source}->{e.target} has no port but {e.target} declares inputs")
        else:
            if bound and e.to_port not in b.input_ports:
                out.append(f"{e.target} has no input port {e.to_port}")
            elif bound:
                fed[(e.target, e.to_port)] += 1
            if (bound if a.output_ports is None else e.from_port not in a.output_ports):
                out.append(f"{e.source} has no output port {e.from_port}")
        if len(out) > before:
            faulty.add(e.target)
    for (node, port), n in sorted(fed.items()):
        if n > 1:
            out.append(f"input {node}.{port} is fed {n} times")
    for n in plan.nodes:
        for p in [*(n.input_ports or []), *(n.output_ports or [])]:
            if p in RESERVED:
                out.append(f"{n.id} uses the reserved port name {p}")
        if n.id not in faulty:
            out += [f"input {n.id}.{p} is not fed" for p in n.input_ports or [] if not fed[(n.id, p)]]
        if n.enabled_when is not None and n.enabled_when not in n.params:
            out.append(f"{n.id} depends on absent parameter {n.enabled_when}")
        for o, i in (n.disabled_passthrough or {}).items():
            if o not in (n.output_ports or []) or i not in (n.input_ports or []):
                out.append(f"{n.id} passes undeclared ports {i}->{o}")
    return out


def abstract_plan() -> Plan:
    """Fetch an abstract, draw its claims, gate them, then summarise or discard."""
    nodes = [Node("fetch", "fetch_abstract"), Node("claims", "llm_call", {"prompt_template": "{abstract}", "model": None, "max_tokens": 512}, resources=["model_client"]), Node("evaluate", "evaluator", {"keywords": [], "threshold": 0.0}), Node("summarize", "llm_summarize", {"prompt_template": "{response}", "model": None, "max_tokens": 512}, resources=["model_client"])]
    return Plan("abstract", nodes, [Edge("fetch", "claims"), Edge("claims", "evaluate"), Edge("evaluate", "summarize", "CONTROL")])


def lookdev_plan() -> Plan:
    """A sample of five nodes."""
    kinds = [("load", "LoadAsset"), ("shade", "ApplyShader"), ("check", "ShaderValidate"), ("render", "Render"), ("approve", "LookApproval")]
    return Plan("lookdev", [Node(i, t) for i, t in kinds], [Edge(a, b, "CONTROL" if a == "check" else "DATA") for (a, _), (b, _) in zip(kinds, kinds[1:])])


#: The citation pipeline's stages, each with its parameters, inputs and outputs.
STAGES = {
    "resolve": (["seeds"], [], ["seeds", "seed_failures"]),
    "backward": (["n_backward", "lambda_decay", "current_year"], ["seeds"], ["backward", "failed_batches"]),
    "forward": (["n_forward", "lambda_decay", "alpha", "beta", "sort", "current_year"], ["seeds"], ["forward", "failed_seeds", "truncated_seeds"]),
    "assemble": ([], ["seeds", "backward", "forward"], ["nodes", "cites", "mismatches"]),
    "clean": ([], ["nodes", "cites"], ["cleaned_edges", "cycle_log", "all_cites"]),
    "co": (["min_strength", "max_edges"], ["nodes", "all_cites"], ["co_citation_edges", "co_citation_warnings"]),
    "annotate": (["llm"], ["nodes", "resolved"], ["nodes", "provenance"]),
    "depth": ([], ["nodes", "cleaned_edges"], ["depth_metrics"]),
    "pagerank": (["damping"], ["nodes", "cleaned_edges"], ["pagerank"]),
    "communities": (["algorithm", "seed", "trials", "teleport", "community_count_min", "community_count_max"], ["nodes", "all_cites"], ["communities", "community_report", "community_warnings"]),
    "enrich": ([], ["nodes", "depth_metrics", "pagerank", "communities"], ["enriched_nodes"]),
}
#: Which stage's output feeds an input, where the name alone does not tell.
PRODUCERS = {("annotate", "resolved"): ("resolve", "seeds"), **{(s, "nodes"): ("assemble", "nodes") for s in ("clean", "co", "annotate")}, **{(s, "nodes"): ("annotate", "nodes") for s in ("depth", "pagerank", "communities", "enrich")}}


def citation_plan(params: dict[str, Any]) -> Plan:
    """The declared citation pipeline."""
    owner = {o: s for s, (_, _, outs) in STAGES.items() for o in outs if o != "nodes"}
    nodes, edges = [], []
    for s, (names, ins, outs) in STAGES.items():
        gate = {"enabled_when": "llm", "disabled_passthrough": {"nodes": "nodes"}, "resources": ["model_client"]} if s == "annotate" else {}
        nodes.append(Node(s, s, {n: params.get(n) for n in names}, input_ports=list(ins), output_ports=list(outs), **gate))
        for i in ins:
            a, port = PRODUCERS.get((s, i), (owner.get(i), i))
            edges.append(Edge(a, s, "DATA", port, i))
    return Plan("citation", nodes, edges)
