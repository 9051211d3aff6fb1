"""The corpus pipeline: quality, line dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the
columns of documents; the last returns tokens. ``run`` writes each stage as Parquet in the shared
folder and reads it again for the next.

The last stage's rows are the documents of the mix, one for each time a document is taken: doc_id,
n_tokens, ids_sha256, decoded_sha256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import byte_bpe, line_dedup, mixing, near_copies, quality
from weftgraph.llm.common import stored, table


#: Frequent pieces that the last stage folds beforehand; fewer than the operator's own number, as earlier stages leave the driver less memory.
MEMO = 40_000


def tidied(spark: SparkSession) -> None:
    """Collects the driver's garbage, as Spark itself does at intervals: the code it generated for the stage before, and with that stage's plans its shuffles' files."""
    spark.sparkContext._jvm.System.gc()


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects; it is fitted on all labelled rows' bounded sample.

    Null and empty texts are scored like others; repeated rows and null doc_ids are rows of their own; no rows give none.
    """
    tidied(spark)
    return quality.accepted(docs, table(spark, sf_dir, "labels"), train=table(spark, sf_dir, "documents"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs."""
    tidied(spark)
    return line_dedup.without_repeated_lines(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies: five-word shingles, 0.8 or more alike.

    Line dedup leaves a later copy only the lines that differ, so documents are compared as they are and, of those
    left, as they were in the ``documents`` table.
    """
    tidied(spark)
    return near_copies.without_near_copies(docs, originals=table(spark, sf_dir, "documents"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources reach their target weights.

    A null source is a source, after all others; a text without words has size 0; a document taken several times is as many rows; no rows give none.
    """
    tidied(spark)
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document of the mix; null and empty texts have none, repeated rows are rows of their own, no rows give none."""
    import public_tokenizers

    tidied(spark)
    return byte_bpe.tokens_digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, memo=MEMO)


STAGES = [("quality", classify), ("line_dedup", dedup_lines), ("simhash", dedup_near), ("mixing", mix), ("byte_bpe", tokenize)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
