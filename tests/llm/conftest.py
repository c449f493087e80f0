"""Documents with what operators must cope with."""

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(seed, n, syllables=("the", "on", "er", "in", "at", "re", "st", "ou", "ly")):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))][0]


@pytest.fixture(scope="session")
def texts():
    base = words(1, 120).split()
    near = base.copy()
    near[60] = "changed"
    out = [
        None, "", "   \n", "Word", "word ", " ".join(base), " ".join(base), " ".join(base).upper(), " ".join(near), words(2, 80), words(3, 5000),
        "Été à la plage, s'il vous plaît! 數字 12 \U0001f600", "<|endoftext|> a<|endoftext|>", "a" * 5000, "\x00\x01 zero\t\x0b end", words(4, 40) + "\nReleased under the MIT License.",
        "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0.", words(5, 60), words(5, 60), "!!! ### $$$", "don't I'LL we've  \n\n x",
    ]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With nulls in every column, ties, repeated rows and ids out of order."""
    rows = [((i * 37) % 101, t, ["en", "fr", None][i % 3], [None, "src0", "src0", "src1"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd(spark, docs):
    """Also a null id, a repeated row, and columns with clashing names."""
    from pyspark.sql import functions as F

    more = spark.createDataFrame([(None, "no id here", "en", "src0", 10), (7, "twice the same row", "en", "src0", 18), (7, "twice the same row", "en", "src0", 18)], SCHEMA)
    every = docs.unionByName(more)
    for name in ("id", "body", "key", "n", "row", "token", "kept", "score", "ids", "stays", "run", "place", "copies"):
        every = every.withColumn(name, F.lit("clash"))
    return every


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
