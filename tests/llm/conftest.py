import pytest
from corpus_texts import SCHEMA, prose


@pytest.fixture(scope="session")
def frame(spark):
    def make(texts, first: int = 0, ids=None):
        rows = [((ids[i] if ids else first + i), t, "en", "src", None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, white space, short, ties, rarer characters, and a very long text."""
    return [None, "", " \n\t ", "one", "two words", "a b c d", "é日本 \u3000x", "don't we'll  go\n\n there", prose(5, 12), prose(5, 12), "x" * 3000, prose(9, 9000), "A\x1db c", "tail  "]
