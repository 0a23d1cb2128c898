import pytest

#: Small documents for edge cases: nulls, empty and repeated texts, ties and a clash of column names.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string"


@pytest.fixture(scope="session")
def odd(spark):
    long = " ".join(f"w{k % 4000}" for k in range(60_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "Hello there you. " * 3, "en", "a", 5), (3, "Hello there you. " * 3, "en", "a", 5), (4, "\x00   \U0001f600 'll're  \n\n", "en", "b", 9), (5, long, "en", "b", 1), (6, long + " end", "en", None, 1), (None, "no id here at all, none", "en", "c", 2)]
    return spark.createDataFrame([(*r, 0.5, "x") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
