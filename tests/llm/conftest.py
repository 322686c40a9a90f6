import os

import pytest

from tests.conftest import SF001, spark  # noqa: F401

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):  # noqa: F811
    """NULLs in every column, empty and very long texts, ties, repeated rows, a column with a clashing name."""
    long = " ".join(f"word{i % 977} and thing" for i in range(30_000))
    rows = [(1, "a b c d e", "en", "s1", 9), (1, "a b c d e", "en", "s1", 9), (2, None, None, None, None), (3, "", "en", "s1", 0), (None, "null id here", "de", "s2", 12),
            (None, None, None, None, None), (4, long, "en", "s1", len(long)), (5, " \t\n ", "en", None, 4), (6, "tab\tand  two spaces\n\nend ", "fr", "s2", 3),
            (7, "Grüße à l'été, n'est-ce pas? 12345 <|endoftext|> it's", "fr", "s2", 1), (8, "a b c d e", "en", "s2", 9), (5, "same id other text", "en", "s3", 1)]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 AS rank", "2 AS length", "'x' AS count", "3 AS size", "0 AS score")


@pytest.fixture(scope="session")
def no_docs(spark):  # noqa: F811
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark):  # noqa: F811
    return spark.read.parquet(f"{SF001}/documents.parquet")
