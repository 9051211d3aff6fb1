"""Importance resampling towards a target: documents are drawn by how much likelier the target makes their n-grams.

A position table has a row for each word of each document: posexplode gives the words, lead() over a document the following
ones, and the runs of one to ``ORDERS`` words that begin there are hashed to buckets. Documents are shuffled
once, before their words are exploded, so that the windows need no further shuffle. The table is written; counting its buckets
gives the corpus side, the same over the target's texts the other side, and joining the gains and adding up gives a document's weight.
What is broadcast is the gains: one row a bucket, so ``BUCKETS`` rows at every size of the input.

Draws are by Gumbel's noise from the document's id, hence without replacement and repeatable: the highest scores are drawn,
found by a range sort over all tasks.

Edge cases: null texts, and texts without words, have no features and weight 0; an empty target counts nothing, and
all gains follow from the corpus; documents below ``LEAST`` words are scored and never drawn; repeated rows are documents
of their own, and of equal scores and ids any order is the same result; a null doc_id hashes as an empty one and comes after others of its score; an
empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import CRC_FOLD, CRC_TABLE, LOWER, UPPER, lowered, numbered, stored, table

#: Fixed by the query contract.
RUN_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, ORDERS, LEAST, SEED = 10_000, 3, 20, 42
SHARE = (5, 100)


def positions(rows: DataFrame, *keep: str, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """``row`` (a number of the document's), ``keep``, and b1, b2, ...: the buckets of the runs that begin at each word.

    A document without words has one row without buckets; runs that would pass its end are null.
    """
    docs = rows.select(F.monotonically_increasing_id().alias("row"), *keep, "text").repartition("row")
    words = docs.select("row", *keep, F.posexplode_outer(F.regexp_extract_all(lowered(F.col("text")), F.lit(RUN_PATTERN), F.lit(0))).alias("pos", "w1"))
    ahead = Window.partitionBy("row").orderBy("pos")
    words = words.select("*", *(F.lead("w1", n).over(ahead).alias(f"w{n + 1}") for n in range(1, orders)))

    def bucket(n: int) -> Column:
        run = F.concat(*[x for i in range(1, n + 1) for x in (F.lit(" "), F.col(f"w{i}"))][1:])  # null if any word is
        return (F.crc32(run.cast("binary")) % buckets).cast("int").alias(f"b{n}")

    return words.select("row", *keep, *map(bucket, range(1, orders + 1)))


def bucket_counts(grams: DataFrame, orders: int = ORDERS) -> DataFrame:
    """bucket, count over all orders; each order reads its own column only."""
    each = [grams.where(F.col(f"b{n}").isNotNull()).groupBy(F.col(f"b{n}").alias("bucket")).agg(F.count("*").alias("count")) for n in range(1, orders + 1)]
    return reduce(DataFrame.unionAll, each).groupBy("bucket").agg(F.sum("count").alias("count"))


def gains_of(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: thousandths of the log ratio of the two smoothed bucket distributions, rounded down. One row a corpus bucket."""
    both = stored(corpus.withColumnRenamed("count", "s").join(target.withColumnRenamed("count", "t"), "bucket", "full").na.fill(0, ["s", "t"]), "bucket-counts")
    s, t = both.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    ratio = (F.col("t") + 1.0) * float(s + buckets) / ((F.col("s") + 1.0) * float(t + buckets))
    return both.where("s > 0").select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel's noise in thousandths from the id's hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def weighed(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """row, doc_id, n_words, n_features, weight of every document, against the texts of ``target``."""
    grams = stored(positions(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", orders=orders, buckets=buckets), "positions")
    gains = stored(gains_of(bucket_counts(grams, orders), bucket_counts(positions(target, orders=orders, buckets=buckets), orders), buckets), "gains")
    for n in range(1, orders + 1):  # at most ``buckets`` rows
        own = F.broadcast(gains.select(F.col("bucket").alias(f"k{n}"), F.col("gain").alias(f"g{n}")))
        grams = grams.join(own, F.col(f"b{n}") == F.col(f"k{n}"), "left").drop(f"k{n}")
    here = lambda n: F.coalesce(F.col(f"g{n}"), F.lit(0))
    found = lambda n: F.when(F.col(f"b{n}").isNotNull(), 1).otherwise(0)
    every = range(1, orders + 1)
    return grams.groupBy("row", "doc_id").agg(F.count("b1").alias("n_words"), F.sum(reduce(Column.__add__, map(found, every))).cast("long").alias("n_features"), F.sum(reduce(Column.__add__, map(here, every))).alias("weight"))


def resampled(docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document; rank is null for those that aren't drawn.

    ``share`` (a part and a whole) of the documents with ``least`` words or more is drawn, rounded down.
    """
    scored = weighed(docs, target).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("all", F.lit(0)).withColumn("short", F.col("n_words") < least)
    placed = numbered(scored, "all", [F.col("short"), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")], "scores")
    fit = F.sum(F.when(~F.col("short"), 1).otherwise(0)).alias("fit")
    drawn = (placed.agg(fit).first()[0] or 0) * share[0] // share[1]
    rank = F.when(~F.col("short") & (F.col("idx") < drawn), F.col("idx") + 1)
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.cast("long").alias("rank"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight and score towards the benchmark's texts, and the ranks of those drawn."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def query_sql() -> str:
    words = lambda t, key: f"SELECT {key} AS id, unnest(ws) AS w1, generate_subscripts(ws, 1) AS pos FROM (SELECT {key}, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{RUN_PATTERN}') AS ws FROM {t})"
    runs = lambda t: f"SELECT id, unnest([w1, w1 || ' ' || w2, w1 || ' ' || w2 || ' ' || w3]) AS f FROM (SELECT *, lead(w1) OVER w AS w2, lead(w1, 2) OVER w AS w3 FROM {t} WINDOW w AS (PARTITION BY id ORDER BY pos))"
    codes = "list_transform(range(len(hex(f)) // 2), lambda i: ('0x' || substr(hex(f), 2 * i + 1, 2))::BIGINT)"
    h = "('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT"
    return f"""
WITH {CRC_TABLE},
dw AS ({words("documents", "doc_id")}), bw AS ({words("benchmark", "item_id")}),
df AS (SELECT id, f, count(*) AS n FROM ({runs("dw")}) WHERE f IS NOT NULL GROUP BY ALL),
bf AS (SELECT f, count(*) AS n FROM ({runs("bw")}) WHERE f IS NOT NULL GROUP BY ALL),
keys AS (SELECT f, {CRC_FOLD.format(codes=codes)} % {BUCKETS} AS b FROM (SELECT f FROM df UNION SELECT f FROM bf), crc),
s AS (SELECT b, sum(n)::BIGINT AS s FROM df JOIN keys USING (f) GROUP BY b),
t AS (SELECT b, sum(n)::BIGINT AS t FROM bf JOIN keys USING (f) GROUP BY b),
g AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1.0)::DOUBLE * ((SELECT sum(s) FROM s) + {BUCKETS})::DOUBLE / ((s + 1.0)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (b)),
w AS (SELECT id AS doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM df JOIN keys USING (f) JOIN g USING (b) GROUP BY id),
c AS (SELECT id AS doc_id, count(*) AS n_words FROM dw GROUP BY id),
x AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(({h} + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score, coalesce(n_words, 0) >= {LEAST} AS fit FROM documents LEFT JOIN w USING (doc_id) LEFT JOIN c USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place, count(*) FILTER (fit) OVER () * {SHARE[0]} // {SHARE[1]} AS drawn FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= drawn THEN place END AS rank FROM r"""
