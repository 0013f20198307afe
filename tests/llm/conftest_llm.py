import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Columns whose names the operators use inside, or return.
CLASHES = ["shard", "key", "h", "size", "rep", "owner", "bucket", "rank", "position", "window_id", "label", "_own_id", "grams", "tokens", "score", "count", "model", "n", "a", "b", "k"]


def make_docs(spark, rows):
    """Rows (doc_id, text[, lang, source]) as a documents table."""
    full = [(r[0], r[1], *(r[2:] or ("en", "s0")), len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(n, seed, vocabulary=5000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edge_rows():
    """Nulls in every column, empty and blank texts, a very long text, ties and repeated rows."""
    long = words(60_000, 1)
    copy = words(80, 2)
    return [
        (1, None), (2, ""), (3, "   \n \n"), (None, "a text without an id " * 5), (None, None, None, None),
        (4, long), (5, long), (6, copy), (7, copy), (7, copy), (8, copy + " tail"), (9, words(50, 3), None, None),
        (9, words(50, 4)), (10, "x"), (11, "x"), (12, "émile ß ñ 中文 🙂 line\nline\n line "), (13, "!!! *** ???"),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return make_docs(spark, edge_rows())


@pytest.fixture(scope="session")
def clashing(spark, edge_docs):
    from pyspark.sql import functions as F

    return edge_docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(4, 14)] + [(9, None, None), (None, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
