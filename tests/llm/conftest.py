import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def hard_rows():
    """Nulls in every column, empty and long texts, repeated rows, ties, odd characters."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    body = "the cat sat on the mat and then some more words follow here to make it long enough for rules " * 3
    return [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", "en", None, 4), (4, "one", None, "b", 3),
        (4, "one", None, "b", 3), (5, long, "en", "a", len(long)), (None, body, "en", "a", None), (6, body, "en", "a", 1),
        (7, body.upper(), "fr", "c", 1), (8, "é 你好 🙂 \x00 　 x" * 5, "zz", "c", 1), (9, "a" * 5000, "en", "a", 5000),
        (10, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" password: hunter2hunter2', "en", "b", 9),
    ]


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    return spark.createDataFrame(hard_rows, DOCUMENTS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
