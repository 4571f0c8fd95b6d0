import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, fp string, component string, rate string, a string, word string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    parts = ["ka", "mo", "ri", "tel", "sun", "vor", "eli", "pan", "dro", "qui", "zé", "ß"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def row(i, text):
    return (i, text, "en", "s", 1, "x", "y", "z", "r", "a", "w")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank, repeated and long rows, ties, and columns with names that operators use themselves."""
    long_text = prose(7, 30_000)
    rows = [row(0, None), row(1, ""), row(2, " \t\n"), row(3, prose(3, 60)), row(3, prose(3, 60)), row(4, prose(3, 60)), row(None, prose(5, 50)), row(None, None), row(6, long_text), row(7, "one two"), row(8, "x" * 70_000)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def make_docs(spark):
    return lambda texts: spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], COLUMNS)


@pytest.fixture(scope="session")
def words():
    return prose
