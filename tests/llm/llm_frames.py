"""Documents for the tests of the llm subpackage, and a comparison."""

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, kept int, id string, `keys` string, row int"


def frame(spark, rows):
    """Documents (id, text, source) with further columns whose names operators use themselves."""
    full = [(i, t, "en", s, len(t or ""), "x", 7, "y", "z", 3) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def rows(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)


@pytest.fixture(scope="session")
def words():
    draw = random.Random(11)
    return ["".join(draw.choice("abdeilmnorstu") for _ in range(draw.randint(2, 8))) for _ in range(3000)]


@pytest.fixture(scope="session")
def prose(words):
    """prose(seed, n): n words, the same for the same seed."""

    def make(seed, n):
        draw = random.Random(seed)
        return " ".join(draw.choice(words) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def edge_rows(prose):
    """Nulls, empty and very long texts, copies, ties and repeated rows."""
    long = prose(1, 40_000)
    return [
        (1, None, "a"), (2, "", "a"), (3, "   \n\t ", None), (4, "one", "b"), (5, "one two three", None),
        (6, prose(6, 200), "a"), (7, prose(6, 200), "b"), (8, prose(6, 200), "a"), (9, long, "a"), (10, long + " more", "a"),
        (11, prose(11, 300), "c"), (11, prose(11, 300), "c"), (12, "Ünïcödé " * 60, "a"), (13, "x" * 5000, "a"), (14, "\x00\x1c   ok", "b"),
        (15, None, None), (None, prose(15, 90), "a"), (None, None, None), (16, "<|endoftext|> Don't 123's", "b"),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return frame(spark, edge_rows).cache()


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where(F.lit(False))
