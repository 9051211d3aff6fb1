"""Mixing sources to target weights by capped water-filling.

Targets: every source gets a share of the budget in proportion to its weight; a source whose share
exceeds ``max_epochs`` times its own size is clamped there and the excess goes to the others by
weight, until none is above. Sampling: ``floor(target / source size)`` whole repetitions of every
document, and one more of the documents with the smallest seeded hashes until the rest is reached.

The document where a source's extra repetition ends is found by a histogram of hashes per source
and then inside one of its bins, so no task ever orders a whole source.

Edge cases: null text has size 0; a null source is a source of its own and comes last; a source
without words has target 0 and its documents are taken 0 times; an empty table gives no rows;
repeated rows and rows with the same or a null doc_id are rows of their own that share one hash and
so are taken alike. Columns besides the documented ones play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import WORD_PATTERN, stored, table

#: Fixed by the query's contract: weights of sources in code point order, repeating.
CYCLE = (3, 1, 2)


def draw_of(seed: int):
    """The seeded hash that orders a source's documents."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size in words, draw."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), words.alias("size"), draw_of(seed).alias("draw"))


def water_fill(sources: DataFrame, budget_share: float, max_epochs: float) -> DataFrame:
    """Adds ``target`` to a table of sources with ``source_size`` and ``weight``.

    With sources in order of the level ``cap / weight`` at which they fill up, the first n are
    clamped for the smallest n whose remaining budget, dealt by weight, fills no further source.
    One row for each source; the windows below run over these only.
    """
    everything = Window.partitionBy()
    order = Window.orderBy("level", F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    leveled = (
        sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(budget_share)))
        .withColumn("total_weight", F.sum("weight").over(everything))
        .withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(order), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(order), F.lit(0)))
        .withColumn("water", (F.col("budget") - F.col("cap_before")) / (F.col("total_weight") - F.col("weight_before")))
    )
    final = F.min(F.when(F.col("water") <= F.col("level"), F.struct("level", "source", "water"))).over(everything)
    return (
        leveled.withColumn("final", final)
        .withColumn("target", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("final.water"))))
        .select("source", "source_size", "weight", "target")
    )


def weighted_sources(rows: DataFrame, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """Size of every source and its weight: ``cycle`` over sources in code point order, null last."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(x) for x in cycle])
    return sizes.withColumn("weight", F.get(weights, (place % len(cycle)).cast("int")))


def extra_limits(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds ``whole`` and ``last``: whole repetitions, and the last hash that gets one more (null: none does)."""
    plan = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    rests = plan.select(F.col("source").alias("r_source"), (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        rows.groupBy("source", F.substring("draw", 1, 3).alias("bin")).agg(F.sum("size").alias("in_bin"))
        .withColumn("before", F.coalesce(F.sum("in_bin").over(before), F.lit(0)))
        .join(rests, F.col("source").eqNullSafe(F.col("r_source")))
        .where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("in_bin") >= F.col("rest")))
        .groupBy("source").agg(F.min(F.struct("bin", "before", "rest")).alias("b")).select(F.col("source").alias("b_source"), "b.*")
    )
    inside = (
        rows.join(bins, F.col("source").eqNullSafe(F.col("b_source")) & (F.substring("draw", 1, 3) == F.col("bin")))
        .groupBy("source", "draw").agg(F.sum("size").alias("size"), F.first("before").alias("before"), F.first("rest").alias("rest"))
        .withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("draw")))
    )
    rest, short = F.col("rest"), F.col("upto") - F.col("size")
    taken = (F.col("upto") <= rest) | ((short < rest) & (F.col("upto") - rest <= rest - short))  # the nearer side of the last document
    ends = inside.groupBy(F.col("source").alias("e_source")).agg(F.max(F.when(taken, F.col("draw"))).alias("end"))
    limits = bins.join(ends, F.col("b_source").eqNullSafe(F.col("e_source")), "left").select("b_source", F.coalesce("end", "bin").alias("last"))
    return plan.join(limits, F.col("source").eqNullSafe(F.col("b_source")), "left").drop("b_source")


def mixing_plan(rows: DataFrame, budget_share: float, max_epochs: float, cycle: tuple[float, ...]) -> DataFrame:
    """One row per source, its columns prefixed ``mix_``: source, source_size, weight, target, whole, last."""
    plan = extra_limits(rows, water_fill(weighted_sources(rows, cycle), budget_share, max_epochs))
    return stored(plan.select([F.col(c).alias(f"mix_{c}") for c in plan.columns]), "mix")


def repeats(draw: str, max_epochs: float):
    n = F.col("mix_whole") + F.when(F.col(draw) <= F.col("mix_last"), 1).otherwise(0)
    return F.least(n, F.lit(int(max_epochs)).cast("long"))


def mix(docs: DataFrame, budget_share: float = 1.5, max_epochs: float = 2.0, cycle: tuple[float, ...] = CYCLE, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, repeats, taken."""
    rows = stored(sized(docs, seed), "sizes")
    plan = mixing_plan(rows, budget_share, max_epochs, cycle)
    n = repeats("draw", max_epochs)
    return rows.join(plan, F.col("source").eqNullSafe(F.col("mix_source"))).select(
        "doc_id", "source", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), n.alias("repeats"), (F.col("size") * n).alias("taken")
    )


def mixed_documents(docs: DataFrame, budget_share: float = 1.5, max_epochs: float = 2.0, cycle: tuple[float, ...] = CYCLE, seed: int = 42) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns it came with."""
    plan = mixing_plan(stored(sized(docs, seed), "sizes"), budget_share, max_epochs, cycle)
    keyed = docs.withColumn("mix_draw", draw_of(seed)).join(plan, F.col("source").cast("string").eqNullSafe(F.col("mix_source")))
    n = repeats("mix_draw", max_epochs)
    keyed = keyed.withColumn("mix_copies", F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<bigint>")))
    return keyed.withColumn("mix_copy", F.explode("mix_copies")).select(*[keyed[c] for c in docs.columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents: 150% of all words, weights 3, 1, 2 repeating, two epochs at most."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def query_sql() -> str:
    """The query in DuckDB's SQL."""
    return r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('42:' || coalesce(doc_id::VARCHAR, 'null')) AS draw
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM rows GROUP BY source),
leveled AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
         sum(weight) OVER () AS total_weight
  FROM sources),
steps AS (
  SELECT *, cap / weight AS level,
         (budget - coalesce(sum(cap) OVER b, 0)) / (total_weight - coalesce(sum(weight) OVER b, 0)) AS water
  FROM leveled
  WINDOW b AS (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT water FROM steps WHERE water <= level ORDER BY level, source NULLS FIRST LIMIT 1),
plan AS (
  SELECT source, source_size, least(cap, coalesce(weight * (SELECT water FROM level), cap)) AS target FROM steps),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM plan),
draws AS (SELECT source, draw, sum(size) AS size FROM rows GROUP BY ALL),
runs AS (
  SELECT d.source, d.draw, d.size, p.target - p.whole * p.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw) AS upto
  FROM draws d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source),
ends AS (
  SELECT source, max(draw) FILTER (WHERE upto <= rest OR (upto - size < rest AND upto - rest <= rest - (upto - size))) AS last
  FROM runs GROUP BY source)
SELECT r.doc_id, r.size, p.source_size, p.target,
       (r.size * least(2, p.whole + CASE WHEN p.target > p.whole * p.source_size AND r.draw <= e.last THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rows r JOIN parts p ON r.source IS NOT DISTINCT FROM p.source
LEFT JOIN ends e ON r.source IS NOT DISTINCT FROM e.source
"""
