import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, an extra column."""
    long_text = "\n".join(f"line {k} of a long text that goes on and on with number {k * k}" for k in range(3000))
    rows = [
        (1, "The cat sat on the mat and looked at the dog. " * 4, "en", "a", 10, "x"),
        (1, "The cat sat on the mat and looked at the dog. " * 4, "en", "a", 10, "x"),
        (2, None, None, None, None, None),
        (3, "", "en", "a", 0, "y"),
        (None, "no id here, only words", "en", None, 1, None),
        (5, long_text, "en", "b", 1, "z"),
        (6, "The cat sat on the mat and looked at the dog. " * 4, "en", "a", 10, "x"),
        (7, "ünï códe 🙂 " * 5, "de", "b", 1, "x"),
        (8, " \t\n ", "de", "b", 1, "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
