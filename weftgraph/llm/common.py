"""Shared pieces: shared-folder tables, bounded Arrow batches, word and hash helpers."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed by the query contracts: a word is a run of bytes that are none of these.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: The letters that the contracts lower-case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``. Where that is unset, a temporary folder serves local mode;
    on a cluster an unset folder is an error, since executors would not see the driver's disk.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The table cuts lineage: a lost executor costs a reread, not a recomputation. Hadoop removes
    it when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(schema).parquet(path)


def numbered(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """The rows with ``idx``, their place in their group by the order (from 0), and ``n``, the group's size.

    A range sort deals any group over many tasks; a row's place is that in its written partition and the counts of the
    partitions before. The order should be total, else a tie's rows are one task's. Group names aren't null.
    """
    keys = [F.col(group), *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(dealt.withColumn("place", F.monotonically_increasing_id()), name).withColumn("part", F.shiftright("place", 33))
    runs = placed.groupBy(group, "part").agg(F.min("place").alias("first"), F.count("*").alias("here"))
    one = Window.partitionBy(group)
    runs = runs.select(group, "part", "first", (F.sum("here").over(one.orderBy("part")) - F.col("here")).alias("before"), F.sum("here").over(one).alias("n"))
    return placed.join(runs, [group, "part"]).withColumn("idx", F.col("before") + F.col("place") - F.col("first")).drop("part", "place", "first", "before")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and the whole text (null: empty), with the named columns and no others."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def lowered(text: Column) -> Column:
    """A-Z in lower case and all else as it is. Where all characters are ASCII, the much faster ``lower`` does the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose column holds about ``limit`` bytes at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
        block = np.concatenate([[0], np.cumsum(sizes)[:-1]]) // limit
        cuts = np.flatnonzero(np.diff(block)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def arrow_map(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def is_space(b: np.ndarray) -> np.ndarray:
    return (b == 32) | ((b >= 9) & (b <= 13))


def word_spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte array."""
    inside = np.concatenate([[False], ~is_space(b), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


STEP = 1 << 16
POWERS: dict[str, np.ndarray] = {}


def powers() -> dict[str, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, and a code for each byte; made once a task."""
    if not POWERS:
        for name, base in (("up", 0x9E3779B97F4A7C15), ("down", pow(0x9E3779B97F4A7C15, -1, 1 << 64))):
            run = np.full(STEP + 1, base, np.uint64)
            run[0] = 1
            POWERS[name] = np.cumprod(run)
        POWERS["code"] = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return POWERS


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal spans have equal hashes wherever they stand."""
    out = np.empty(len(starts), np.uint64)
    p = powers()
    first = 0
    while first < len(starts):  # powers restart in each block, so that tables stay small
        at = int(starts[first])
        last = int(np.searchsorted(ends, at + STEP, side="right"))
        if last <= first:  # a span longer than a block
            import xxhash

            out[first] = xxhash.xxh64_intdigest(b[at : ends[first]].tobytes(), 7)
            first += 1
            continue
        s, e = starts[first:last] - at, ends[first:last] - at
        sums = np.zeros(int(e[-1]) + 1, np.uint64)
        np.cumsum(p["code"][b[at : ends[last - 1]]] * p["up"][: int(e[-1])], out=sums[1:])
        out[first:last] = mix64((sums[e] - sums[s]) * p["down"][s] + (e - s).astype(np.uint64))
        first = last
    return out


def shipped(spark: SparkSession, model):
    """A fitted model of bounded size for the executors, which may not have this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def unpacked(box):
    return pickle.loads(box.value)


#: DuckDB has no crc32: its 256 steps as a table ``crc``, and a fold over a list of bytes, for the queries' SQL.
CRC_TABLE = "crc AS (SELECT list(v ORDER BY i) AS steps FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM range(256) t(i)))"
CRC_FOLD = "xor(list_reduce([4294967295] || {codes}, lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"
