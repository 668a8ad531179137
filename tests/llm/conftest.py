from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside or return: an input may have columns of that name.
CLASHING = ("score", "fp", "component_id", "keep_id", "_text", "_len", "d", "h", "key", "size", "draws", "_stays", "_bad", "kept", "row", "_c_0", "start")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in any column, empty and very long texts, ties, repeated rows, odd white space and letters."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    rows = [(1, None, None, None, None), (None, "a text without an id", "en", "s1", 20), (2, "", "en", "s1", 0), (3, " \n\t ", None, "s2", 4), (4, long, "en", "s1", len(long)), (5, long, "en", "s2", len(long))]
    rows += [(6, "Ünïcode ÀÉ straße 東京 \U0001f600 zwölf", "de", "é", 30), (7, "the same row", "en", "s1", 12), (7, "the same row", "en", "s1", 12), (7, "the same id, another text", "en", None, 25), (8, "the same row", None, "s2", 12)]
    return rows + [(100 + i, prose(rng, rng.randint(1, 60)), rng.choice(["en", "fr"]), rng.choice(["s1", "s2", None]), i) for i in range(60)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def odd_wide(odd):
    """The odd rows with extra columns whose names clash."""
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
