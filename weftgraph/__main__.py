"""Command line: stats, workflows, validate, check, run, query, view and serve (one JSON request a line)."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from weftgraph.functions import handlers
from weftgraph.plans import model, projection
from weftgraph.plans.runner import run

PLANS = {"citation": lambda: model.citation_plan({}), "abstract": model.abstract_plan, "lookdev": model.lookdev_plan}


def load(name: str) -> model.Plan:
    """A named plan, or the one in a JSON file."""
    if name in PLANS:
        return PLANS[name]()
    p = Path(name)
    if not p.is_file():
        raise ValueError(f"no plan or file {name}")
    return model.Plan.from_json(p.read_text())


def answer(plan: model.Plan, request: dict):
    """One tool call: get_node, get_edges_from, update_node, summarize_intent, validate_graph or execute_graph."""
    tool, a = request.get("tool"), request.get("arguments", {})
    if tool == "get_node":
        node = plan.node(a["node_id"])
        return {"error": f"no node {a['node_id']}"} if node is None else vars(node)
    if tool == "get_edges_from":
        return [vars(e) for e in plan.edges_from(a["node_id"])]
    if tool == "update_node":
        return vars(plan.update_node(a["node_id"], a["params"]))
    if tool == "summarize_intent":
        return model.intent(plan, a.get("node_ids") or None)
    if tool == "validate_graph":
        return model.integrity(plan)
    if tool == "execute_graph":
        kinds = sorted({n.type for n in plan.nodes})
        out = run(plan, handlers.mock(handlers.registry(), kinds) if a.get("mock") else handlers.registry(), a.get("resources"))
        return {i: {k: v for k, v in r.items() if k != "exception"} for i, r in out.items()}
    return {"error": f"no tool {tool}"}


def main(args: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="weftgraph", description=__doc__)
    sub = ap.add_subparsers(dest="command", required=True)
    for name in ("stats", "check", "serve"):
        sub.add_parser(name).add_argument("--plan", default="citation")
    sub.add_parser("workflows")
    sub.add_parser("validate").add_argument("plan")
    r = sub.add_parser("run")
    r.add_argument("paper_id")
    r.add_argument("--mock", action="store_true")
    q = sub.add_parser("query")
    q.add_argument("kind", choices=["downstream", "upstream", "topo", "intent"])
    q.add_argument("node", nargs="?")
    q.add_argument("--plan", default="citation")
    v = sub.add_parser("view")
    v.add_argument("--plan", default="citation")
    v.add_argument("--out", required=True)
    o = ap.parse_args(args)
    show = lambda x: print(json.dumps(x, default=str, ensure_ascii=False))
    try:
        if o.command == "workflows":
            show(sorted(PLANS))
        elif o.command == "stats":
            show(model.summary(load(o.plan)))
        elif o.command in ("validate", "check"):
            found = model.integrity(load(o.plan))
            show(found)
            return int(not found["valid"])
        elif o.command == "query":
            plan = load(o.plan)
            if o.kind in ("downstream", "upstream"):
                if not o.node:
                    raise ValueError(f"{o.kind} needs a node")
                show(getattr(model, o.kind)(plan, o.node))
            else:
                show(model.topological(plan) if o.kind == "topo" else model.intent(plan, [o.node] if o.node else None))
        elif o.command == "view":
            Path(o.out).write_text(projection.page(projection.declared_graph(load(o.plan)), "plan"))
        elif o.command == "run":
            plan = model.abstract_plan()
            plan.update_node("fetch", {"paper_id": o.paper_id})
            kinds = ["fetch_abstract", "llm_call", "llm_summarize"] if o.mock else []
            out = run(plan, handlers.mock(handlers.registry(), kinds), {"model_client": None})
            show({i: {k: v for k, v in r.items() if k != "exception"} for i, r in out.items()})
            return int(any(r["status"] == "FAILED" for r in out.values()))
        else:
            plan = load(o.plan)
            for line in sys.stdin:
                try:
                    show(answer(plan, json.loads(line)))
                except Exception as e:  # noqa: BLE001  one bad request must not end the service
                    show({"error": str(e)})
    except Exception as e:  # noqa: BLE001
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
