import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(n))


def rows_of(texts, sources=("s0", "s1", "s2")):
    return [(i, t, "en", sources[i % len(sources)], len(t) if t is not None else None) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def texts():
    """Prose with exact and near copies, shared lines and passages."""
    rng = random.Random(3)
    base = ["\n".join(prose(rng, rng.randint(5, 60)) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    out = list(base)
    out += [base[0], base[0], base[1], base[2].replace("a", "e", 1), base[3] + " end"]
    shared, passage = "this very line stands in many of them", prose(rng, 70)
    out += [f"{prose(rng, 30)}\n{shared}\n{prose(rng, 20)}" for _ in range(9)]
    out += [f"{prose(rng, 12)} {passage} {prose(rng, 9)}" for _ in range(3)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), SCHEMA)


NAMES = "n_lines n_dropped row_number position shard slot_in slot bin part offset h k t c id v words toxicity keep group_id block __n __k __b __first __c __at __id __in node root".split()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, and columns whose names an operator might use."""
    rng = random.Random(5)
    long = prose(rng, 12_000)
    texts = [None, "", " ", "\n\n", "a", "same text here", "same text here", long, long, "é中 \U0001f600 x" * 30, "the " * 400, prose(rng, 80), "a\r\nb\tc\x0bd"]
    rows = rows_of(texts) + [(7, long, None, None, None), (None, "no id at all", "en", "s0", 3), (None, None, None, None, None), (5, "same text here", "en", "s2", 14), (5, "same text here", "en", "s2", 14), (5, "other text, same id", "en", "s1", None)]
    schema = T.StructType(SCHEMA.fields + [T.StructField(n, T.StringType()) for n in NAMES])
    return spark.createDataFrame([r + tuple("x" for _ in NAMES) for r in rows], schema)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(60)] + [(None, None, None), (3, None, None)], "doc_id long, quality int, toxic int")
