"""Traversals with their edges, assembly, result tables and tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import scalars
from weftgraph.operators import graph


def inside(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges with the source among ``sources`` and the target among ``targets``, each once."""
    s, t = sources.select(F.col("node_id").alias("s_id")), targets.select(F.col("node_id").alias("t_id"))
    return edges.join(s, F.col("source_id") == F.col("s_id"), "left_semi").join(t, F.col("target_id") == F.col("t_id"), "left_semi").dropDuplicates(["source_id", "target_id"])


def with_year(edges: DataFrame, works: DataFrame) -> DataFrame:
    """source_id, target_id, type and the citing work's year."""
    own = works.select(F.col("node_id").alias("w_id"), F.col("year").alias("citing_paper_year"))
    return edges.join(own, F.col("source_id") == F.col("w_id"), "left").select("source_id", "target_id", F.lit("cites").alias("type"), "citing_paper_year")


def backward_traverse(seeds: DataFrame, works: DataFrame, cites: DataFrame, n: int, decay: float, year: int) -> tuple[DataFrame, DataFrame]:
    """(papers, edges) two hops along references.

    Papers are the best ``n`` by score, without seeds. Depth 2 is reached through every depth-1 work, seeds too. Edges run from
    seeds to depth 1 (seed to seed as well) and from depth-1 works that are no seeds to depth 2; those with both ends among
    papers and seeds stay.
    """
    reached = graph.backward(seeds, cites).join(works, "node_id")
    papers = graph.top(reached, scalars.backward_score(F.col("citation_count"), F.col("hop_depth"), F.col("year"), year, decay), n)
    ids = papers.select("node_id").union(seeds.select("node_id"))
    first = cites.join(seeds.select(F.col("node_id").alias("x")), F.col("source_id") == F.col("x"), "left_semi").select(F.col("target_id").alias("node_id"))
    starts = seeds.select("node_id").union(first).distinct()
    return papers, with_year(inside(inside(cites.select("source_id", "target_id"), starts, ids), ids, ids), works)


def sort_columns(sort: str) -> list[Column]:
    """Order by a request's sort text: a field and asc or desc, parted by a colon; ties by id."""
    field, _, way = sort.partition(":")
    # The fields' names in a request.
    names = {"cited_by_count": "citation_count", "publication_year": "year", "publication_date": "year"}
    if field not in names or way not in ("", "asc", "desc"):
        raise ValueError(f"sort {sort!r} is unknown")
    column = F.col(names[field])
    return [column.desc_nulls_last() if way == "desc" else column.asc_nulls_last(), F.col("source_id")]


def forward_traverse(seeds: DataFrame, works: DataFrame, cites: DataFrame, n: int, decay: float, alpha: float, beta: float, year: int, sort: str = "cited_by_count:desc", page: int = 200, method: str = "mean") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(papers, edges, truncated seeds): the best ``n`` citers of the seeds.

    Each seed gives a page of its citers in the order asked for, before anything is scored. Citers that are seeds are left
    out with their edges. Acceleration comes from ``counts_by_year``, where works have it.
    """
    if method == "regression":
        raise NotImplementedError("acceleration by regression")
    if method != "mean":
        raise ValueError(f"acceleration method {method!r} is unknown")
    known = works.select(F.col("node_id").alias("w_id"), "citation_count", "year")
    mine = graph.citers(seeds, cites.join(known, F.col("source_id") == F.col("w_id")).select("source_id", "target_id", "citation_count", "year"), sort_columns(sort), page)
    truncated = mine.groupBy("seed").agg(F.count("*").alias("returned"), F.first("total").alias("total")).where("returned < total")
    fresh = mine.join(seeds.select(F.col("node_id").alias("x")), F.col("source_id") == F.col("x"), "left_anti").select("source_id", "target_id", "seed")
    found = fresh.groupBy(F.col("source_id").alias("node_id")).agg(F.array_sort(F.collect_set("seed")).alias("root_ids")).withColumn("hop_depth", F.lit(1)).join(works, "node_id")
    speed = scalars.acceleration(F.col("counts_by_year")) if "counts_by_year" in works.columns else F.lit(None).cast("double")
    papers = graph.top(found, scalars.forward_score(F.col("citation_count"), F.col("year"), speed, year, alpha, beta, decay), n)
    return papers, with_year(inside(fresh.select("source_id", "target_id"), papers, seeds), works), truncated


def assemble(seeds: DataFrame, backward: tuple[DataFrame, DataFrame], forward: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, cites, mismatches) of seeds, then backward, then forward; of one node the first record, with the roots of all."""
    names = [c for c in seeds.columns if c in backward[0].columns and c in forward[0].columns and c not in ("ord", "score")]
    parts = [p.select(*names).withColumn("ord", F.col("node_id")) for p in (seeds, backward[0], forward[0])]
    nodes = graph.first_seen(parts, ["node_id"]).drop("ord", "src_rank", "root_ids")
    roots = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("node_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("root_ids")))).alias("root_ids"))
    edges = [e.withColumn("ord", F.struct("source_id", "target_id")) for e in (backward[1], forward[1])]
    key = ["source_id", "target_id", "type"]
    return nodes.join(roots, "node_id"), graph.first_seen(edges, key).drop("ord", "src_rank"), graph.edge_mismatches(edges, ["citing_paper_year"])


def result_edges(cleaned: DataFrame, cocited: DataFrame) -> DataFrame:
    """Cleaned citations and co-citations in one table, sorted by source, target and type at its output only."""
    a = cleaned.select("source_id", "target_id", F.lit("cites").alias("type"), F.lit(None).cast("long").alias("strength"))
    return a.unionByName(cocited.select("source_id", "target_id", F.lit("co_citation").alias("type"), F.col("strength").cast("long").alias("strength")))


def affected(suppressed: DataFrame) -> DataFrame:
    """The nodes at either end of a suppressed edge."""
    return suppressed.select(F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct()


def direction_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.coalesce("traversal_direction", F.lit("unknown")).alias("direction")).agg(F.count("*").alias("n"))


def community_summary(labels: DataFrame, least: int, most: int, algorithm: str = "label_propagation") -> DataFrame:
    """One row: the number of communities, and whether it is below ``least`` or above ``most``."""
    n = labels.agg(F.count_distinct("community_id").alias("community_count"))
    return n.withColumns({"below_min": F.col("community_count") < least, "above_max": F.col("community_count") > most, "algorithm": F.lit(algorithm)})


def corpus_description(nodes: DataFrame) -> DataFrame:
    """Numbers of works by depth and label."""
    label = F.col("relationship_type") if "relationship_type" in nodes.columns else F.lit(None).cast("string")
    return nodes.groupBy("hop_depth", label.alias("label")).agg(F.count("*").alias("n"))


def ordered_warnings(edges: DataFrame, nodes: DataFrame, order: list[str]) -> DataFrame:
    """Endpoints that are no nodes, each at its first place in the edges' order, source before target."""
    ends = edges.select(*order, F.posexplode(F.array("source_id", "target_id")).alias("end", "node_id"))
    return ends.join(nodes.select("node_id"), "node_id", "left_anti").groupBy("node_id").agg(F.min(F.struct(*order, "end")).alias("first"))


def keyword_gate(text: Column, keywords: list[str], threshold: float = 0.5) -> Column:
    """Struct of score and matched_keywords; raises, when read, under the threshold."""
    hit = [F.when(F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(k.lower())), F.lit(k)) for k in keywords]
    matched = F.array_compact(F.array(*hit)) if hit else F.array().cast("array<string>")
    score = F.size(matched) / F.lit(float(len(keywords))) if keywords else F.lit(0.0)
    out = F.struct(score.alias("score"), matched.alias("matched_keywords"))
    return F.when(score < threshold, F.raise_error(F.concat(F.lit("score "), F.format_number(score, 2), F.lit(f" below threshold {threshold}"))).cast("struct<score:double,matched_keywords:array<string>>")).otherwise(out)


def nearest(nodes: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    """The node nearest to a point within the radius, ties by id."""
    apart = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    return nodes.withColumn("apart", apart).where(F.col("apart") <= radius * radius).orderBy("apart", "node_id").limit(1).drop("apart")


def shown(edges: DataFrame, nodes: DataFrame, cocitations: bool) -> DataFrame:
    """Edges a viewer draws: both ends there, co-citations only if asked for."""
    kept = edges if cocitations else edges.where("type <> 'co_citation'")
    ids = nodes.select("node_id")
    return kept.join(ids, F.col("source_id") == F.col("node_id"), "left_semi").join(ids, F.col("target_id") == F.col("node_id"), "left_semi")
