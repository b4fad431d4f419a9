import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents out of texts or (doc_id, text[, lang[, source]]) rows, with columns that clash with what operators name."""

    def make(rows, extra=True):
        full = []
        for i, r in enumerate(rows):
            r = (i, r) if r is None or isinstance(r, str) else r
            r = (*r, *(None, None)[len(r) - 2 :]) if len(r) < 4 else r
            full.append((*r, None if r[1] is None else len(r[1])))
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for c in ("size", "h", "key", "component_id", "score", "src", "spans", "packed", "block", "digest", "th", "fp", "words"):
                df = df.withColumn(c, F.lit(7))
        return df

    return make


@pytest.fixture(scope="session")
def prose():
    """Random texts of n words out of a vocabulary of its own."""

    def make(n, seed, size=5000):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(size)}" for _ in range(n))

    return make
