"""The citation pipeline's stages as plan functions over Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import scalars
from weftgraph.operators import annotate, communities, cycles, graph, traversal
from weftgraph.plans.runner import Registry
from weftgraph.sources import works as works_source


def _none(like: DataFrame, schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame([], schema)


def registry(works: DataFrame, cites: DataFrame) -> Registry:
    """Stages over works (node_id, citation_count, year, counts_by_year and more if there are) and cites (source_id, target_id).

    Seeds are node ids, or records such as ``{"doi": ...}``, for which works need a ``doi``.

    Reads of a table fail as a whole or not at all, so ``failed_batches`` and ``failed_seeds`` are empty here; with an online
    source, ``sources.works.lookup`` gives them. ``annotate`` takes the resource ``model_client``, a function from prompt to answer.
    """
    r = Registry()

    @r.register("resolve")
    def resolve(params, inputs):
        if any(isinstance(s, dict) for s in params["seeds"]):
            found, failed = works_source.resolve_seeds(works, params["seeds"])
            return {"seeds": found, "seed_failures": failed}
        wanted = works.sparkSession.createDataFrame([(i, s) for i, s in enumerate(params["seeds"])], "ord long, node_id string")
        found = wanted.join(works, "node_id", "left")
        seeds = found.where(F.col("citation_count").isNotNull())
        if not seeds.limit(1).count():
            raise ValueError("no seed was found")
        seeds = seeds.withColumn("hop_depth", F.lit(0)).withColumn("root_ids", F.array("node_id"))
        return {"seeds": seeds, "seed_failures": found.where(F.col("citation_count").isNull()).select("node_id", F.lit("no results").alias("reason"))}

    @r.register("backward")
    def backward(params, inputs):
        papers, edges = traversal.backward_traverse(inputs["seeds"], works, cites, params["n_backward"], params["lambda_decay"], params["current_year"])
        return {"backward": {"papers": papers, "edges": edges}, "failed_batches": _none(works, "ids array<string>, stage string, reason string")}

    @r.register("forward")
    def forward(params, inputs):
        papers, edges, short = traversal.forward_traverse(inputs["seeds"], works, cites, params["n_forward"], params["lambda_decay"], params["alpha"], params["beta"], params["current_year"], params["sort"] or "cited_by_count:desc")
        return {"forward": {"papers": papers, "edges": edges}, "failed_seeds": _none(works, "node_id string, reason string"), "truncated_seeds": short}

    @r.register("assemble")
    def assemble(params, inputs):
        back, forth = ((inputs[k]["papers"], inputs[k]["edges"]) for k in ("backward", "forward"))
        nodes, edges, mismatches = traversal.assemble(inputs["seeds"], back, forth)
        return {"nodes": nodes, "cites": edges, "mismatches": mismatches}

    @r.register("clean")
    def clean(params, inputs):
        kept, gone = cycles.clean_cycles(inputs["nodes"], inputs["cites"])
        return {"cleaned_edges": kept, "cycle_log": gone, "all_cites": kept.select("source_id", "target_id").union(gone.select("source_id", "target_id"))}

    @r.register("co")
    def co(params, inputs):
        e = graph.cocitation(inputs["all_cites"], inputs["nodes"], params["min_strength"] or 2, params["max_edges"])
        return {"co_citation_edges": e, "co_citation_warnings": traversal.ordered_warnings(inputs["all_cites"], inputs["nodes"], ["source_id", "target_id"])}

    @r.register("annotate")
    def annotated(params, inputs, *, resources):
        own = params["llm"]
        nodes, provenance = annotate.annotate(inputs["nodes"], inputs["resolved"], resources["model_client"], own["model"], own.get("temperature", 0.0), own["max_tokens"])
        return {"nodes": nodes, "provenance": provenance}

    @r.register("depth")
    def depth(params, inputs):
        roots = inputs["nodes"].where(F.array_contains("root_ids", F.col("node_id"))).select("node_id")
        return {"depth_metrics": graph.depth_metrics(inputs["nodes"], inputs["cleaned_edges"], roots)}

    @r.register("pagerank")
    def rank(params, inputs):
        return {"pagerank": graph.pagerank(inputs["nodes"], inputs["cleaned_edges"], params["damping"] or 0.85)}

    @r.register("communities")
    def groups(params, inputs):
        algorithm = params["algorithm"] or "map_equation"
        allowed = {"map_equation": ("seed", "trials", "teleport"), "modularity": ("seed",)}.get(algorithm, ())
        options = {n: params[n] for n in allowed if params[n] is not None}
        found = communities.detected(inputs["nodes"], inputs["all_cites"], algorithm, params["community_count_min"] or 1, params["community_count_max"], **options)
        return {"communities": found["communities"], "community_report": found["report"], "community_warnings": found["warnings"]}

    @r.register("enrich")
    def enrich(params, inputs):
        return {"enriched_nodes": graph.enrich(inputs["nodes"], inputs["depth_metrics"], inputs["pagerank"], inputs["communities"])}

    return r


def result(out: dict[str, dict]) -> dict[str, DataFrame]:
    """The run's tables as a caller wants them: nodes, edges (cleaned citations, then co-citations, by source and target), and the reports."""
    at = lambda stage, port: out[stage][port]
    edges = traversal.result_edges(at("clean", "cleaned_edges"), at("co", "co_citation_edges"))
    return {
        "nodes": at("enrich", "enriched_nodes"), "edges": edges.orderBy("type", "source_id", "target_id"), "cycle_log": at("clean", "cycle_log"), "seed_failures": at("resolve", "seed_failures"),
        "mismatches": at("assemble", "mismatches"), "truncated_seeds": at("forward", "truncated_seeds"), "co_citation_warnings": at("co", "co_citation_warnings"),
        "communities": at("communities", "community_report"), "community_warnings": at("communities", "community_warnings"),
    }
