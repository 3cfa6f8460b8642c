import pytest

SCHEMA = "doc_id long, text string, lang string, key string, row int, n int, piece int, fetch string, root int, first int, spans int, words int"


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang), with more columns of names used inside."""

    def make(*rows):
        return spark.createDataFrame([(*r, *[None] * (3 - len(r)), "k", 1, 2, 3, "f", 4, 5, 6, 7) for r in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def prose():
    """Different words of invented prose, by seed."""
    import numpy as np

    def make(n, seed=0):
        return [f"w{x}" for x in np.random.default_rng(seed).integers(0, 50_000, n)]

    return make
