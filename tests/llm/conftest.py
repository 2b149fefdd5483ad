from __future__ import annotations

import random

import pytest

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lam", "mu", "nu", "xi"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    rows = [
        (1, "one two three four five", "en", "a", 5),
        (2, "one two three four five", "en", "a", 5),
        (2, "one two three four five", "en", "a", 5),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \t\n\x0b", None, "b", 3),
        (None, "null id text with words", "de", None, 1),
        (None, "one two three four five", None, "a", 1),
        (6, words(60_000, 1), "en", "a", 1),
        (7, words(300, 2), "en", "c", 1),
        (8, words(300, 2).upper(), "en", "c", 1),
        (9, "ß é 漢字 words\nß é 漢字 words", "de", "c", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def stored(spark, tmp_path_factory):
    """Writes tables as the driver stores them; returns the folder."""

    def put(**tables):
        folder = tmp_path_factory.mktemp("sf")
        for name, df in tables.items():
            df.write.parquet(f"file://{folder}/{name}.parquet")
        return f"file://{folder}"

    return put
