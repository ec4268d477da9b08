import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, bucket int, node long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns with names that the operators use."""
    long_text = " ".join(f"word{i % 5000} the of" for i in range(60_000))
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta", "en", "a", 1, "k", 1, 1, 1),
        (2, "alpha BETA gamma delta epsilon zeta", "en", "a", 1, "k", 1, 1, 1),
        (2, "alpha BETA gamma delta epsilon zeta", "en", "a", 1, "k", 1, 1, 1),
        (3, None, None, None, None, None, None, None, None),
        (4, "", "en", "b", 0, None, None, None, None),
        (5, "   \n\t ", "en", "b", 3, None, None, None, None),
        (None, "alpha beta gamma delta epsilon zeta", "en", None, 1, "x", 2, 2, 2),
        (None, None, None, None, None, None, None, None, None),
        (6, long_text, "en", "a", len(long_text), "k", 1, 1, 1),
        (7, long_text + " tail", "en", "c", 1, "k", 1, 1, 1),
        (8, "two words", "en", "c", 9, "k", 1, 1, 1),
        (9, "TWO WORDS", "en", "c", 9, "k", 1, 1, 1),
        (10, "É è password = \"Zk3vQ9xLm2\" all rights reserved", "fr", "a", 9, "k", 1, 1, 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (8, 0, 1), (9, 0, 1), (None, 1, 1), (10, None, None)], "doc_id long, quality int, toxic int")
