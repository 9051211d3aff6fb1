"""Exact top-k search by distributed histogram selection.

Queries go in blocks of bounded size. For a block, every candidate is scored; each task counts the
scores of each query in bins, and the summed histograms show in which bin the k-th highest score
lies. That bin is cut again until it is one score wide. A last pass keeps what reaches the k-th score
and breaks ties by the smaller id; no task sends more than k rows of a query.

Scores are inner products of integer vectors, computed exactly: in double precision where no score can pass
2**53, else in 64-bit integers. Where scores could pass 2**62, the search raises; so do components of 2**62 or more.

Edge cases: vectors that are null, or hold null or non-finite components, take no part; candidates of
another length than the query score over the common positions of the longer one padded with zeros;
fewer candidates than k are all returned; rows with the query's own id are no candidates; repeated
rows are candidates of their own, but one query (of several vectors under one id, the least asks); null ids
take no part; no queries or an empty table give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import shipped, stored, table, unpacked

BINS, BLOCK = 256, 1024
MOST = 1 << 62


def integer_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and the vector's components as floor(scale * x); vectors that take no part are left out."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))

    def whole(v: Column) -> Column:
        big = v * F.lit(float(scale))
        return F.when(F.abs(big) < float(MOST), F.floor(big).cast("long")).otherwise(F.raise_error(F.lit("a component of 2**62 or more")).cast("long"))

    return rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


def matrix(column: pa.Array, dim: int, kind: type) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), kind)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for i, n in enumerate(sizes):
        out[i, : min(n, dim)] = flat[at[i] : at[i] + min(n, dim)]
    return out


def scored(batches: Iterator[pa.RecordBatch], q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and scores (queries by candidates) of a few thousand candidates at a time; q's type is the arithmetic."""
    for b in batches:
        for a in range(0, b.num_rows, 2048):
            part = b.slice(a, 2048)
            s = q @ matrix(part.column(1), q.shape[1], q.dtype.type).T
            yield part.column(0).to_numpy(), s if s.dtype == np.int64 else np.rint(s).astype(np.int64)


def longest(vectors: DataFrame) -> float:
    """The greatest norm."""
    square = lambda s, v: s + v.cast("double") * v.cast("double")
    return vectors.select(F.sqrt(F.aggregate("v", F.lit(0.0), square)).alias("n")).agg(F.max("n")).first()[0] or 0.0


def bounds_of(candidates: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, reach: int) -> np.ndarray:
    """The k-th highest score of each query of the block, or the lowest possible (-reach) with fewer candidates."""
    spark = candidates.sparkSession
    low = np.full(len(ids), -reach, np.int64)
    width = 1
    while width * BINS < -2 * int(low.min(initial=0)) + 2:
        width *= BINS
    above = np.zeros(len(ids), np.int64)
    while True:
        box = shipped(spark, (ids, q, low.copy(), width))

        def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, low, width = unpacked(box)
            counts = np.zeros((len(ids), BINS), np.int64)
            base = np.arange(len(ids))[:, None] * BINS
            for own, s in scored(batches, q):
                bin_ = (s - low[:, None]) // width
                inside = (bin_ >= 0) & (bin_ < BINS) & (own[None, :] != ids[:, None])
                counts += np.bincount((base + bin_)[inside], minlength=counts.size).reshape(counts.shape)
            i, j = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(counts[i, j])], names=["q", "bin", "n"])

        got = candidates.mapInArrow(histogram, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        higher = Window.partitionBy("q").orderBy(F.desc("bin"))
        need = spark.createDataFrame([(i, int(k - a)) for i, a in enumerate(above)], "q int, need long")
        cut = got.withColumn("upto", F.sum("n").over(higher)).join(need, "q").where("upto >= need").groupBy("q").agg(F.max(F.struct("bin", "upto", "n")).alias("x"))
        found = {r.q: r.x for r in cut.collect()}  # one row for each query of the block
        for i in range(len(ids)):
            if i in found:
                low[i] += found[i].bin * width
                above[i] += found[i].upto - found[i].n
        if width == 1:
            return low
        width //= BINS


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score. ``rows`` and ``queries`` have vec_id and v, integer vectors."""
    spark = rows.sparkSession
    candidates = stored(rows, "candidates")
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    reach = int((longest(candidates) + 1) * (longest(queries) + 1) * (1 + 1e-9)) + 1
    if reach >= MOST:
        raise ValueError("scores could pass 2**62")
    kind = np.float64 if reach < 1 << 53 else np.int64
    count = queries.count()
    blocks = max(1, -(-count // block))
    asked = stored(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), "queries") if blocks > 1 else queries.withColumn("block", F.lit(0))
    parts = []
    for n in range(blocks):
        rows_here = asked.where(F.col("block") == n).orderBy("vec_id").collect()  # about ``block`` rows
        if not rows_here:
            continue
        ids = np.array([r.vec_id for r in rows_here], np.int64)
        dim = max(1, max(len(r.v) for r in rows_here))
        q = np.zeros((len(ids), dim), kind)
        for i, r in enumerate(rows_here):
            q[i, : len(r.v)] = r.v
        least = bounds_of(candidates, ids, q, k, reach)
        box = shipped(spark, (ids, q, least))

        def keep(batches: Iterator[pa.RecordBatch], box=box) -> Iterator[pa.RecordBatch]:
            ids, q, least = unpacked(box)
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for own, s in scored(batches, q):
                hit = (s >= least[:, None]) & (own[None, :] != ids[:, None])
                for i in np.flatnonzero(hit.any(axis=1)).tolist():
                    at = np.flatnonzero(hit[i])
                    a, b = best.get(i, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    a, b = np.concatenate([a, own[at]]), np.concatenate([b, s[i, at]])
                    order = np.lexsort((a, -b))[:k]
                    best[i] = a[order], b[order]
            for i, (a, b) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), ids[i])), pa.array(a), pa.array(b)], names=["query_id", "vec_id", "score"])

        parts.append(candidates.mapInArrow(keep, "query_id long, vec_id long, score long"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = reduce(DataFrame.unionAll, parts).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all other rows for every row whose vec_id is divisible by 50."""
    rows = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0))


def query_sql() -> str:
    return """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
