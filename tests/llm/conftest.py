import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, a long one, repeated rows, and columns with clashing names."""
    long = " ".join(f"w{i % 700}x{i % 13}" for i in range(30_000))
    rows = [(1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (4, long, "b"), (5, "one two three", "a"), (5, "one two three", "a"), (None, "nobody knows", "b"), (7, "One  two\nthree", None)]
    return spark.createDataFrame([(i, t, s, 0, 0, "k") for i, t, s in rows], "doc_id long, text string, source string, key int, n_words int, id string")
