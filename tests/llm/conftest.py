"""A small table of documents with every awkward case: nulls in any column, empty and blank texts, a very long one,
ties, repeated rows, and columns whose names clash with those that operators add."""

import random

import pytest


def prose(rng, words, pool):
    return " ".join(rng.choice(pool) for _ in range(words))


@pytest.fixture(scope="session")
def awkward_rows():
    rng = random.Random(3)
    pool = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    texts = [prose(rng, rng.randint(1, 120), pool) for _ in range(60)]
    texts += ["", "", "   \n\t ", None, None, "Ünï cödé — ✓ 😀", "a", "same text here", "same text here", "Same Text here", "x" * 5000]
    texts += [prose(rng, 30_000, pool), texts[0], texts[0] + " tail", "line one\nline one\nline two\n\n \n"]
    rows = [(n, t, rng.choice(["en", None]), rng.choice(["s0", "s0", "s0", "s1", "s2", None]), 7, "k") for n, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, "no id", "en", "s1", 1, None), (None, "no id", None, "s1", 1, None), (70, "another text for an id", None, "s2", 1, "z")]
    return rows


#: The last two columns clash with names that operators add.
SCHEMA = "doc_id long, text string, lang string, source string, size long, kept string"


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
