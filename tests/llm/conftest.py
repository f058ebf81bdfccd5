import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, "one", "en", "a", 3), (5, "One  two", "en", None, 8),
    (6, "same words here again and again " * 30, "en", "a", 900), (7, "same words here again and again " * 30, "en", "b", 900),
    (8, LONG, "en", "b", len(LONG)), (9, "é ü ñ 漢字 \U0001f600 a b c\x1cd", "fr", "b", 20), (9, "é ü ñ 漢字 \U0001f600 a b c\x1cd", "fr", "b", 20),
    (None, "a row without an id", "en", "c", 19), (11, "x" * 70_000, "en", "c", 70_000), (12, "line\r\nline\r\n\r\nline", None, "c", 18),
]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, other white space, extra columns with clashing names."""
    df = spark.createDataFrame(ODD, SCHEMA)
    clash = ["size", "key", "n", "shard", "slot", "row_key", "nth", "target", "kept", "score", "host", "bytes", "range", "a", "b", "base", "block", "word", "line", "label", "component_id", "taken"]
    return df.select("*", *[F.lit("clash").alias(c) for c in clash])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
