import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (doc_id, text) pairs; every third row has a null source."""

    def make(*rows, parts=3):
        filled = [(i, t, "en", None if k % 3 == 2 else f"src{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(filled, DOCUMENTS).repartition(parts)

    return make


@pytest.fixture(scope="session")
def crowded():
    """A table with extra columns whose names operators use inside."""

    def add(df):
        names = "fp sig runs start length times all bin within n leaf exact segments score size window windows raw typed label value key mask gone one".split()
        return df.withColumns({name: F.lit(7) for name in names if name not in df.columns})

    return add


@pytest.fixture(scope="session")
def prose():
    """Different texts of made-up words."""
    import random

    def write(seed, words=120):
        draw = random.Random(seed)
        return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(words))

    return write
