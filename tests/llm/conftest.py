import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, token string, set string"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table from (id, text[, lang[, source]]) rows, with more columns whose names clash."""

    def make(*rows):
        full = [(*r, *[None] * (4 - len(r)))[:4] for r in rows]
        values = [(i, t, lang, source, None if t is None else len(t), 7.0, "x", "y") for i, t, lang, source in full]
        return spark.createDataFrame(values, DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def sentences():
    """n distinct invented sentences of m words."""
    import random

    def make(n, m=40, seed=1, syllables="ka lo mi ru te su no pa vi dre".split()):
        r = random.Random(seed)
        return [" ".join("".join(r.choices(syllables, k=3)) for _ in range(m)) for _ in range(n)]

    return make


@pytest.fixture(scope="session")
def rows():
    """Collected rows of a table as dictionaries by a column."""
    return lambda df, key="doc_id": {r[key]: r.asDict() for r in df.collect()}
