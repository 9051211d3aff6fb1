"""Runs a plan: every port carries a value, usually a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from weftgraph.plans.model import Plan, topological
from weftgraph.sources.store import cut


class PlanError(Exception):
    pass


class PortBindingError(PlanError):
    pass


class UnregisteredTypeError(PlanError):
    pass


class InjectedOutputError(PlanError):
    pass


class DuplicateNodeError(PlanError):
    pass


class UnsuppliedResourceError(PlanError):
    pass


class HaltError(PlanError):
    """The first failed node of a run, in dependency order."""

    def __init__(self, node_id: str, error: str, results: dict):
        super().__init__(f"{node_id}: {error}")
        self.node_id, self.error, self.results = node_id, error, results


class Registry:
    """Node types and their functions: fn(params, inputs[, resources=...]) -> dict of outputs. The last registered wins."""

    def __init__(self):
        self.functions: dict[str, Callable] = {}

    def register(self, kind: str, fn: Callable | None = None):
        if fn is None:
            return lambda f: self.register(kind, f)
        self.functions[kind] = fn
        return fn


def _written(value):
    """The value with every DataFrame in it, or in a dict of it, as a written table."""
    if isinstance(value, dict):
        return {k: _written(v) for k, v in value.items()}
    return cut(value) if isinstance(value, DataFrame) else value


def run(plan: Plan, registry: Registry, resources: dict[str, Any] | None = None, outputs: dict[str, dict] | None = None, materialise: bool = True) -> dict[str, dict]:
    """Results by node: outputs with status SUCCESS, FAILED (error, exception) or SKIPPED (skip_reason).

    Spark is lazy, so with ``materialise`` every DataFrame output is written inside the node's fence and a failure
    belongs to the node that caused it.
    """
    resources, outputs, results = resources or {}, outputs or {}, {}
    ids = [n.id for n in plan.nodes]
    if len(set(ids)) < len(ids):
        raise DuplicateNodeError(sorted({i for i in ids if ids.count(i) > 1}))
    order = topological(plan)
    missing = sorted({n.type for n in plan.nodes} - set(registry.functions))
    if missing:
        raise UnregisteredTypeError(missing)
    lacking = sorted({r for n in plan.nodes for r in n.resources or []} - set(resources))
    if lacking:
        raise UnsuppliedResourceError(lacking)
    unknown = sorted(set(outputs) - set(ids))
    if unknown:
        raise InjectedOutputError(unknown)
    for i in order:
        node = plan.node(i)
        into = [e for e in plan.edges if e.target == i]
        bad = next((e.source for e in into if results[e.source]["status"] == "FAILED" or (results[e.source]["status"] == "SKIPPED" and "disabled_by" not in results[e.source])), None)
        if bad is not None:
            results[i] = {"status": "SKIPPED", "node_id": i, "skip_reason": f"upstream {bad} did not succeed"}
            continue
        off = node.enabled_when is not None and not node.params.get(node.enabled_when)
        if i in outputs and not off and node.input_ports != []:  # a node that is skipped or disabled has no use for it
            raise InjectedOutputError(i)
        try:
            if node.input_ports is None:
                inputs = {e.source: {k: v for k, v in results[e.source].items() if k not in ("status", "node_id")} for e in into}
            else:
                inputs = {}
                for e in into:
                    if e.to_port is None:
                        continue
                    if e.from_port not in results[e.source]:
                        raise PortBindingError(f"{e.source} gave no {e.from_port} for {i}.{e.to_port}")
                    inputs[e.to_port] = results[e.source][e.from_port]
            if off:
                passed = {o: inputs[p] for o, p in (node.disabled_passthrough or {}).items() if p in inputs}
                results[i] = {**passed, "status": "SKIPPED", "node_id": i, "disabled_by": node.enabled_when}
                continue
            if i in outputs:
                results[i] = {**outputs[i], "status": "SUCCESS", "node_id": i, "injected": True}
                node.status = "SUCCESS"
                continue
            more = {"resources": {r: resources[r] for r in node.resources}} if node.resources else {}
            got = registry.functions[node.type](node.params, inputs, **more)
            if materialise:
                got = {k: _written(v) for k, v in got.items()}
            results[i] = {**got, "status": "SUCCESS", "node_id": i}
            node.status = "SUCCESS"
        except Exception as e:  # noqa: BLE001  the fence: whatever a stage raises is that node's failure
            results[i] = {"status": "FAILED", "node_id": i, "error": str(e), "exception": e}
            node.status = "FAILED"
    return results


def halted(plan: Plan, results: dict[str, dict]) -> dict[str, dict]:
    """The results, or HaltError for the first node that failed."""
    for i in topological(plan):
        if results[i]["status"] == "FAILED":
            raise HaltError(i, results[i]["error"], results) from results[i]["exception"]
    return results
