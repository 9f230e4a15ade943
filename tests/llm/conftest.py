from __future__ import annotations

import random

import pytest

TABLES = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """Documents from texts or (id, text) pairs, with columns that clash with inner names."""

    def make(*items, source="a"):
        rows = []
        for i, item in enumerate(items):
            doc_id, text = item if isinstance(item, tuple) else (i, item)
            rows.append((doc_id, text, None, source, 7, "mine", True, 1))
        return spark.createDataFrame(
            rows, "doc_id bigint, text string, lang string, source string, n_words bigint, _text string, kept boolean, size int"
        )

    return make


@pytest.fixture
def prose():
    """Seeded sentences over a small invented vocabulary."""

    def make(n, seed):
        rng = random.Random(seed)
        words = ["".join(rng.choice("bdklmnrst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(400)]
        return " ".join(rng.choice(words) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def given(spark):
    """Rows of a given table."""
    return lambda name: [r.asDict() for r in spark.read.parquet(f"{TABLES}/{name}.parquet").collect()]
