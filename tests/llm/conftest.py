import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n", T.LongType()), T.StructField("chunk", T.StringType()),
])
LINE = "the quick brown fox jumps over the lazy dog near a quiet river bank today"
LONG = " ".join(f"w{i}" for i in range(3000))
# Nulls, empty and blank texts, ties, repeated rows, a very long text, and columns whose names clash with inner ones.
ROWS = [
    (1, LINE, "a", 1, "x"), (2, LINE + " indeed", "a", None, None), (3, None, None, 3, "x"), (4, "", "b", 4, "y"), (5, " \t\n ", "b", 5, "y"),
    (6, "one two", "b", 6, "z"), (7, LONG, "c", 7, "z"), (7, LONG, "c", 7, "z"), (None, "alone among others here", "a", 8, None), (8, LINE.upper(), None, 9, "x"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
