"""Citation corpora on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.sources.store import table


def order_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bipartite cites: an order cites its parts, in the order's year."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    e = li.join(o, li.l_orderkey == o.o_orderkey).select("l_orderkey", "l_partkey", F.year("o_orderdate").alias("citing_paper_year")).distinct()
    return e.select(F.concat(F.lit("order:"), "l_orderkey").alias("source_id"), F.concat(F.lit("part:"), "l_partkey").alias("target_id"), F.lit("cites").alias("type"), "citing_paper_year")


def part_chain(spark: SparkSession, sf_dir: str, acyclic: bool = True) -> DataFrame:
    """Parts at successive lines of an order, larger key to smaller (or as they come, with cycles)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    nxt = li.select(F.col("l_orderkey").alias("o2"), F.col("l_partkey").alias("t"), (F.col("l_linenumber") - 1).alias("n2"))
    e = li.join(nxt, (F.col("l_orderkey") == F.col("o2")) & (F.col("l_linenumber") == F.col("n2"))).select(F.col("l_partkey").alias("s"), "t")
    if acyclic:
        e = e.where("s > t")
    return e.distinct().select(F.format_string("part:%06d", "s").alias("source_id"), F.format_string("part:%06d", "t").alias("target_id"))


def returned_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts at successive lines of an order that were both returned, as they come, with cycles."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_linenumber")
    nxt = li.select(F.col("l_orderkey").alias("o2"), F.col("l_partkey").alias("t"), (F.col("l_linenumber") - 1).alias("n2"))
    e = li.join(nxt, (F.col("l_orderkey") == F.col("o2")) & (F.col("l_linenumber") == F.col("n2"))).select(F.col("l_partkey").alias("s"), "t").distinct()
    return e.select(F.format_string("part:%06d", "s").alias("source_id"), F.format_string("part:%06d", "t").alias("target_id"))


def supplier_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to nation to region."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    up = s.select(F.concat(F.lit("supplier:"), "s_suppkey").alias("source_id"), F.concat(F.lit("nation:"), "s_nationkey").alias("target_id"))
    return up.union(n.select(F.concat(F.lit("nation:"), "n_nationkey"), F.concat(F.lit("region:"), "n_regionkey")))
