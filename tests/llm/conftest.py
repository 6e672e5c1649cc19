"""Documents with every awkward case, and small helpers."""

import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}{c}" for a in ("ba", "ko", "ri", "mu", "te") for b in ("lan", "sor", "vit", "gem") for c in ("a", "o", "is", "en", "ur")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, langs=None, ids=None):
        rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", f"src{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOC)

    return make


@pytest.fixture(scope="session")
def awkward(make_docs):
    """Nulls in any column, empty and very long texts, repeated rows, and columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    rng = random.Random(3)
    long = prose(rng, 30_000)
    texts = [None, "", "   ", "x", long, long, long + " tail", "same words here", "same words here", None, prose(rng, 60)]
    docs = make_docs(texts, ids=[0, 1, 2, 3, 4, 5, 6, 7, 7, None, 10], langs=["en", None, "en", "en", "en", "en", None, "en", "en", "en", "en"])
    for name in ("component_id", "score", "h", "key", "node", "a", "b", "uid", "hits", "t", "_bad"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
