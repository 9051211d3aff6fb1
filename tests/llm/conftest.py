import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd_rows(spark):
    """Nulls everywhere, empty, blank and long texts, repeated rows and ids, one hot source, clashing extra columns."""
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (3, " \n\t ", "en", "a", 4), (4, "X" * 70_000, None, "a", 70_000), (5, "One two three\n" * 60, "en", "b", None),
            (5, "One two three\n" * 60, "en", "b", None), (None, "No name here at all", "en", "b", 3), (None, "No name here at all", "en", "b", 3), (6, "Same id one", "en", "b", 3), (6, "same ID two", "en", "", 3), (7, "Aé漢🙂 " * 900, "fr", "c", 1)]
    rows += [(100 + i, f"The Text number {i % 7} of a hot source, the text", "en", "hot", 5) for i in range(90)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("k", "idx", "n", "h", "tree", "word", "pos", "bucket", "score", "rank", "weight", "size"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)
