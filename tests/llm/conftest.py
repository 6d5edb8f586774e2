import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows, extra=""):
    """documents from (doc_id, text) rows; two partitions at least."""
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(2)


@pytest.fixture
def odd_rows():
    """Null id, null text, empty and blank texts, repeated rows, ties, a very long text."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "Delta", "épée", "x1", "the", "of"]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    some = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) + ".\nEnd of it.") for i in range(20)]
    return [(100, None), (101, ""), (102, " \n\t "), (None, "no id here"), (None, None), (103, long), (104, "same text"), (104, "same text"), (105, "same text"), *some]


@pytest.fixture
def odd(spark, odd_rows):
    return make(spark, odd_rows)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def labels(spark):
    rows = [(i, i % 2, (i // 2) % 2) for i in range(20)] + [(None, 1, 1), (3, None, None), (7, 1, None), (7, 1, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
