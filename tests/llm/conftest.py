import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with names that the operators use inside.
CLASHING = ["fp", "node", "key", "size", "row", "s", "start", "keep_id", "shard", "spans", "host", "words", "_h", "_norm", "text_sha256"]

COPY = "The quick brown fox jumps over the lazy dog and runs away through the long grass of the meadow by the river"


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and clashing columns."""
    from pyspark.sql import functions as F

    long_ = " ".join(f"w{i * 7919 % 5003}" for i in range(40_000))
    rows = [
        (1, COPY, "en", "s1", 10), (2, COPY.upper(), "en", "s2", 10), (3, None, None, None, None), (4, "", "en", "s1", 0), (5, long_, "de", "s1", 1), (6, long_ + " end", None, "s3", 1),
        (7, COPY, "en", None, 10), (7, COPY, "en", None, 10), (8, " \t\n", "fr", "s2", 3), (9, "é ß 漢字 😀", "de", "s2", 3), (10, COPY.replace("fox", "cat"), "en", "s1", 10), (None, "no id here", None, "s1", 1),
        (11, "line one is here\nline one is here\nline two", "en", "s1", 9), (12, "12345 !!! ...", "en", "s3", 2), (13, "x" * 9000, "fr", "s3", 2), (14, "<|endoftext|>Released under the MIT License.", "en", "s3", 2),
    ]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in CLASHING:
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
