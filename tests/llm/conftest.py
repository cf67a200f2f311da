import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


def make(spark, rows):
    """documents rows from (doc_id, text, lang, source)."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], DOCS)


def edge_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    r = random.Random(5)
    vocab = ["the", "of", "and", "river", "stone", "bridge", "walks", "über", "été", "naïve", "x1", "a,b"]

    def prose(n):
        return " ".join(r.choice(vocab) for _ in range(n))
    base = prose(60)
    return [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, None), (4, "word", "en", None),
        (5, base, "en", "a"), (6, base, "en", "a"), (6, base, "en", "a"), (7, base + " tail", "en", "b"),
        (8, prose(5000), "fr", "b"), (9, "\n".join([base] * 4), None, "b"), (None, prose(30), "en", "c"),
        (None, None, None, None), (10, "z" * 30000, "de", "c"), (11, prose(25) + " \u0001\u0002 \U0001F600 " + prose(9), "de", "c"),
        (1 << 40, prose(40), "en", "c"), (-3, prose(40), "en", "c"),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    return make(spark, edge_rows()).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])


@pytest.fixture(scope="session")
def clashing(edge):
    """Extra columns named like internal and output columns."""
    from pyspark.sql import functions as F
    names = ["_t", "_w", "_key", "_block", "block", "bucket", "size", "target", "score", "kept", "label", "comp", "id",
             "n_words", "host", "bin", "lane", "slot", "hi", "lo", "cluster", "toxic", "component_id", "next_text"]
    return edge.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]
