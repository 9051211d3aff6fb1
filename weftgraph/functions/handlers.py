"""Small stages of the design and abstract plans, and the pure functions of a plan's canvas."""

from __future__ import annotations

import re
from typing import Any

from weftgraph.operators import annotate
from weftgraph.plans.model import Edge, Node, Plan
from weftgraph.plans.runner import Registry
from weftgraph.sources import ledger

#: Fixed value: what counts as a hex colour.
HEX = re.compile(r"^#([0-9a-fA-F]{3}|[0-9a-fA-F]{6})$")


def _first(inputs: dict) -> dict:
    return next(iter(inputs.values()), {})


def color_swatch(params, inputs):
    if not HEX.match(params["hex"]):
        raise ValueError(f"{params['hex']!r} is no hex colour")
    return {"hex": params["hex"], "name": params.get("name", "")}


def color_array(params, inputs):
    bad = [c for c in params["colors"] if not HEX.match(c)]
    if bad:
        raise ValueError(f"no hex colours: {bad}")
    return {"colors": list(params["colors"])}


def schema(params, inputs):
    """Roles of a token file, as dotted keys, or those given."""
    import json
    from pathlib import Path

    return {"roles": sorted(ledger.flatten(json.loads(Path(params["path"]).read_text()))) if params.get("path") else list(params["roles"])}


def assign(params, inputs):
    return {"tokens": {params["role"]: _first(inputs)["hex"]}}


def array_assign(params, inputs):
    """Roles and colours by position, as many as the shorter has."""
    given = {k: v for i in inputs.values() for k, v in i.items()}
    return {"tokens": dict(zip(params.get("roles") or given["roles"], given["colors"]))}


def write_tokens(params, inputs):
    """Tokens of all inputs, the last of one role winning, put over the file's."""
    tokens = {k: v for i in inputs.values() for k, v in i.get("tokens", {}).items()}
    return {"tokens": ledger.write_tokens(params["path"], tokens), "written": len(tokens)}


def evaluator(params, inputs):
    """Share of the keywords in the response; raises under the threshold, so that what follows is skipped."""
    given = _first(inputs)
    keywords, text = params.get("keywords", []), given.get("response", "").lower()
    matched = [k for k in keywords if k.lower() in text]
    score = len(matched) / len(keywords) if keywords else 0.0
    if score < params.get("threshold", 0.5):
        raise ValueError(f"score {score:.2f} below threshold {params.get('threshold', 0.5)}, matched {matched}")
    return {"score": score, "matched_keywords": matched, **given}


def registry() -> Registry:
    r = Registry()
    for name, fn in {
        "color_swatch": color_swatch, "color_array": color_array, "schema": schema, "assign": assign, "array_assign": array_assign, "write_tokens": write_tokens,
        "evaluator": evaluator, "llm_call": annotate.llm_call, "llm_summarize": annotate.llm_call, "discard": annotate.discard,
    }.items():
        r.register(name, fn)
    return r


def mock(registry_: Registry, kinds: list[str]) -> Registry:
    """A registry whose named types return a fixed text and what came in; for plans run without services."""
    r = Registry()
    r.functions |= registry_.functions
    for k in kinds:
        r.register(k, lambda params, inputs, k=k, **_: {"paper_id": params.get("paper_id", "mock"), **_first(inputs), "response": f"mock {k}"})
    return r


def compatible(source: tuple[str, str], target: tuple[str, str]) -> bool:
    """Whether a port (side, type) may feed another: out to in, of one type, or a dict of tokens to a role."""
    return source[0] == "out" and target[0] == "in" and (source[1] == target[1] or (source[1], target[1]) == ("token_dict", "token_role"))


def wired(plan: Plan, edge: Edge) -> Plan:
    """The plan with the edge; an edge that fed the same input port goes."""
    kept = [e for e in plan.edges if (e.target, e.to_port) != (edge.target, edge.to_port) or edge.to_port is None]
    return Plan(plan.name, plan.nodes, [*kept, edge], plan.version)


def fitted(values: list[Any], n: int, filler: Any = None) -> list[Any]:
    """The list cut or padded to n."""
    return (values + [filler] * n)[:n]


def snapshot(name: str, boxes: list[dict], wires: list[dict]) -> Plan:
    """A plan from a canvas's boxes (id, type, params) and wires (source, target, from_port, to_port)."""
    return Plan(name, [Node(b["id"], b["type"], dict(b.get("params", {}))) for b in boxes], [Edge(w["source"], w["target"], "DATA", w.get("from_port"), w.get("to_port")) for w in wires])


def colour_plan(path: str) -> Plan:
    nodes = [Node("palette", "color_array", {"colors": ["#112233", "#abc"]}), Node("roles", "schema", {"roles": ["text.main", "text.dim"]}), Node("assign", "array_assign"), Node("write", "write_tokens", {"path": path})]
    return Plan("colours", nodes, [Edge("palette", "assign"), Edge("roles", "assign"), Edge("assign", "write")])
