import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, seed string, fp string, position double, _row long"


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, columns with clashing names."""
    long_ = " ".join(f"w{i % 5000}" for i in range(60_000))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [
        (1, "alpha beta " * 3 + passage, "en", "a", 1), (2, passage + " other end", None, "a", None), (2, passage + " other end", None, "a", None), (3, None, "en", None, 0),
        (4, "", None, "b", 0), (None, passage, None, "c", None), (None, None, None, None, None), (5, long_, "en", "a", 3), (6, long_ + " x", "en", "d", 3),
        (7, "same " * 200, "en", "e", 5), (8, "  \n\t ", "en", "f", 5), (9, "é É ünï 漢字 " * 30, "de", "g", 5), (10, " two  spaces \n and a line\n", "en", "b", 1), (11, "word", "en", "b", 1),
    ]
    return spark.createDataFrame([(*r, "s", "f", 0.5, 9) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
