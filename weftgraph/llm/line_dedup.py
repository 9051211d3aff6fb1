"""Line dedup with a suffix array over sequences of line ids.

A document is the sequence of its lines that have ``least`` or more words; shorter ones are
passed over and always stay. Suffixes of all sequences are ordered by prefix doubling: a suffix's rank
at depth d and the rank of the suffix d further on give its rank at depth 2d, each round being a sort of
the distinct pairs. Suffixes that are alone in their rank are settled and leave the rounds.

Suffixes with one rank at depth d are an interval of the suffix array whose common prefixes have d
lines or more. All suffixes of an interval but the one that starts earliest are later copies, and
their d lines go. A repeated run of more lines is covered by its runs of d, so ranks at depth
``min_lines`` find all lines of all maximal runs; the rounds end there. A single line of
``min_words`` words is a run too.

"Earlier" is by doc_id (null last), then line number. Overlaps count, and lines are judged on the input.

Edge cases: null text is empty, one line without words; repeated rows (same doc_id, same text) are one
document, each of them losing what that one loses; a repeated doc_id with other texts orders by the
texts' hash; an empty table gives no rows. Columns besides doc_id and text play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import WORD_PATTERN, stored, table

LEAST, MIN_LINES, MIN_WORDS = 3, 2, 20
DOC = ("k", "th")


def keyed(docs: DataFrame) -> list[Column]:
    """Order of documents: doc_id, null last, then a hash of the text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")]


def line_table(docs: DataFrame, least: int = LEAST, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each line that counts: document, line number i, place q among the lines that count, id (h, g), whether it is long."""
    n_words = lambda x: F.regexp_count(x, F.lit(WORD_PATTERN))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"), n_words(x).alias("n")))
    rows = docs.select(*keyed(docs), F.posexplode(F.filter(lines, lambda e: e["n"] >= least)).alias("q", "e"))
    return rows.select("k", "th", "q", F.col("e.i").alias("i"), F.xxhash64("e.x").alias("h"), F.hash("e.x").alias("g"), (F.col("e.n") >= min_words).alias("long"))


def ranks(keys: DataFrame) -> DataFrame:
    """The distinct rows of ``keys`` with their place in ascending order as ``rank``.

    Sorted in ranges; a row's place is its place in its range after all rows of lower ranges.
    """
    names = keys.columns
    parts = keys.repartitionByRange(*names).sortWithinPartitions(*names)
    held = stored(parts.select(*names, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")), "ranks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    bases = held.groupBy("part").agg(F.count("*").alias("n")).select(F.col("part").alias("b_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return held.join(F.broadcast(bases), F.col("part") == F.col("b_part")).select(*names, (F.col("base") + F.col("place")).alias("rank"))


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with the document and place of the first occurrence."""
    return rows.groupBy(*keys).agg(F.count("*").alias("times"), F.min(F.struct(*DOC, "q")).alias("first")).where("times > 1")


def doubled(rows: DataFrame, step: int) -> DataFrame:
    """From ranks at some depth to ranks ``step`` lines deeper; settled suffixes are left out."""
    ahead = Window.partitionBy(*DOC).orderBy("q").rangeBetween(step, step)
    pairs = stored(rows.select(*DOC, "q", "i", F.col("rank").alias("a"), F.first("rank").over(ahead).alias("b")).where("b IS NOT NULL"), "pairs")
    again = stored(repeated(pairs, "a", "b"), "groups")
    order = ranks(again.select("a", "b")).select(F.col("a").alias("ra"), F.col("b").alias("rb"), "rank")
    named = again.join(order, (F.col("a") == F.col("ra")) & (F.col("b") == F.col("rb"))).select("ra", "rb", "rank", "first")
    out = pairs.join(named, (F.col("a") == F.col("ra")) & (F.col("b") == F.col("rb")))
    return out.select(*DOC, "q", "i", "rank", "first")


def copies(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, least: int = LEAST) -> DataFrame:
    """document (k, th) and number i of every line that a later copy covers; rows may repeat."""
    lines = stored(line_table(docs, least, min_words).distinct(), "lines")  # repeated rows are one document
    again = stored(repeated(lines, "h", "g"), "repeated")
    order = ranks(again.select("h", "g")).select(F.col("h").alias("rh"), F.col("g").alias("rg"), "rank")
    named = again.join(order, (F.col("h") == F.col("rh")) & (F.col("g") == F.col("rg"))).select("rh", "rg", "rank", "first")
    rows = lines.join(named, (F.col("h") == F.col("rh")) & (F.col("g") == F.col("rg"))).select(*DOC, "q", "i", "long", "rank", "first")
    rows = stored(rows, "suffixes")
    later = F.struct(*DOC, "q") != F.col("first")
    gone = rows.where(F.col("long") & later).select(*DOC, "q", F.lit(1).alias("depth"))
    depth, at = 1, rows.select(*DOC, "q", "i", "rank")
    while depth < min_lines:
        step = min(depth, min_lines - depth)
        at, depth = doubled(at, step), depth + step
    if min_lines > 1:
        gone = gone.unionByName(at.where(later).select(*DOC, "q", F.lit(min_lines).alias("depth")))
    else:
        gone = rows.where(later).select(*DOC, "q", F.lit(1).alias("depth"))
    covered = gone.select(*DOC, F.explode(F.expr("sequence(q, q + depth - 1)")).alias("q"))
    places = lines.select(F.col("k").alias("lk"), F.col("th").alias("lt"), F.col("q").alias("lq"), "i")
    return covered.distinct().join(places, (F.col("k") == F.col("lk")) & (F.col("th") == F.col("lt")) & (F.col("q") == F.col("lq"))).select(*DOC, "i")


def deduped(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, least: int = LEAST, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (what is left, null only where it was), n_lines, removed (line numbers), and the columns ``more``."""
    gone = copies(docs, min_lines, min_words, least).groupBy(*DOC).agg(F.array_sort(F.collect_set("i")).alias("gone"))
    gone = gone.select(F.col("k").alias("gk"), F.col("th").alias("gt"), "gone")
    rows = docs.select(*docs.columns, *[c.alias(f"own_{n}") for c, n in zip(keyed(docs), DOC)])
    lines = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("line_list"), i)), "\n"))
    joined = rows.join(gone, (F.col("own_k") == F.col("gk")) & (F.col("own_th") == F.col("gt")), "left").withColumn("line_list", lines)
    removed = F.coalesce("gone", F.array().cast("array<int>")).alias("removed")
    return joined.select("doc_id", text.alias("text"), F.greatest(F.coalesce(F.size("line_list"), F.lit(1)), F.lit(1)).alias("n_lines"), removed, *more)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs (maximal removed runs), kept_sha256 of every document."""
    done = deduped(table(spark, sf_dir, "documents"))
    runs = F.size(F.filter(F.transform("removed", lambda x, i: F.struct(x.alias("x"), F.get(F.col("removed"), i - 1).alias("p"))), lambda e: e["p"].isNull() | (e["p"] != e["x"] - 1)))
    return done.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), runs.cast("long").alias("n_runs"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents without later copies of lines; those that lose all their words this way go."""
    done = deduped(docs, more=tuple(c for c in docs.columns if c not in ("doc_id", "text")))
    lost = (F.size("removed") > 0) & ~F.col("text").rlike(WORD_PATTERN)
    out = done.where(~F.coalesce(lost, F.lit(False)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def query_sql() -> str:
    return r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(ls, 1) - 1 AS i, unnest(ls) AS x
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
w AS (SELECT *, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n FROM l),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS q FROM w WHERE n >= 3),
p AS (SELECT *, lead(x) OVER d AS x2, lead(i) OVER d AS i2 FROM s WINDOW d AS (PARTITION BY doc_id ORDER BY q)),
f AS (
  SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id, q) AS one,
         CASE WHEN x2 IS NOT NULL THEN row_number() OVER (PARTITION BY x, x2 ORDER BY doc_id, q) END AS two
  FROM p),
gone AS (
  SELECT doc_id, i FROM f WHERE n >= 20 AND one > 1
  UNION SELECT doc_id, i FROM f WHERE two > 1
  UNION SELECT doc_id, i2 FROM f WHERE two > 1),
runs AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM gone),
tally AS (SELECT doc_id, count(*) AS n_removed, count(DISTINCT run) AS n_runs FROM runs GROUP BY doc_id),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, coalesce(string_agg(CASE WHEN g.i IS NULL THEN x END, chr(10) ORDER BY l.i), '') AS text
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT k.doc_id, k.n_lines, coalesce(t.n_removed, 0)::BIGINT AS n_removed, coalesce(t.n_runs, 0)::BIGINT AS n_runs, sha256(k.text) AS kept_sha256
FROM kept k LEFT JOIN tally t ON t.doc_id = k.doc_id
"""
