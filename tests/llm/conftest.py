import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    T.StructField("size", T.StringType()), T.StructField("shard", T.IntegerType()), T.StructField("fp", T.StringType()), T.StructField("th", T.StringType()),
    T.StructField("row", T.StringType()), T.StructField("position", T.StringType()), T.StructField("c0", T.StringType()),
])


def _rows():
    long = " ".join(f"word{k % 977} and{k % 13}" for k in range(30_000))
    texts = [
        (1, "a short text about nothing in particular, with words", "a"), (2, None, "a"), (3, "", None), (4, long, "b"), (5, "x", "b"),
        (6, "éü\U0001f600 mixed   code points \x00 and a nul", "c"), (7, "same text twice " * 40, "c"), (8, "same text twice " * 40, "c"),
        (9, "same text twice " * 40 + "!", "a"), (9, "same text twice " * 40 + "!", "a"), (9, "an id that is used again", "a"), (None, "a row without an id", None), (None, None, None), (10, " \t\n\x0b\x0c\r ", "a"),
    ]
    return [(i, t, "en", s, None if t is None else len(t), "7", 3, "q", "w", "r", "p", "z") for i, t, s in texts]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns whose names clash with the operators' own."""
    return spark.createDataFrame(_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
