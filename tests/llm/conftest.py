import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, key string, rank int"


def _rows():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    base = [word() for _ in range(80)]
    texts = [" ".join(word() for _ in range(rnd.randint(1, 120))) for _ in range(40)]
    texts += [" ".join(base), " ".join(base), " ".join(base[:-1] + ["other"]), "", None, "   \n\t", "!!! ???", "x", "Ünïcödé " * 30, "word " * 3000, " ".join(word() for _ in range(20_000))]
    rows = [(i, t, rnd.choice(["en", "fr"]), rnd.choice(["a", "b", None]), 1, 1, 0.5, "k", 1) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, "a null id", None, None, None, None, None, None, None), (None, None, "en", "a", 0, 0, 0.0, "", 0)]
    return rows


@pytest.fixture(scope="session")
def odd_rows():
    return _rows()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
