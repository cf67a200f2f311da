"""Exact semantic top-k and the hybrid candidate set."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuelens.operators import semantic as S

VECTORS = T.StructType([T.StructField("id", T.LongType()), T.StructField("repo", T.StringType()),
                        T.StructField("vec", T.ArrayType(T.FloatType()))])


def clustered(n=3000, dim=16, hot=900, seed=3):
    """Rows around 30 directions, a third of them one repeated vector."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(30, dim))
    x = centres[r.integers(0, 30, n)] + r.normal(scale=0.05, size=(n, dim))
    x[:hot] = x[0]
    return [(int(i), f"r{i % 3}", [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))]


def by_force(queries, chunks, k, grouped):
    good = [(i, g, np.asarray(v, float)) for i, g, v in chunks if v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for qi, qg, qv in queries:
        q = np.asarray(qv, float)
        pairs = [(-round(float(q @ v / np.sqrt((q @ q) * (v @ v))), 9), i) for i, g, v in good
                 if i != qi and len(v) == len(q) and (not grouped or g == qg)]
        out += [(qi, rank, i, -s) for rank, (s, i) in enumerate(sorted(pairs)[:k], 1)]
    return sorted(out)


def same(got, want):
    got = sorted(tuple(r) for r in got)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=2e-9)


@pytest.mark.parametrize("grouped", [False, True])
def test_topk_equals_brute_force_and_skips_pairs(spark, grouped):
    data = clustered()
    df = spark.createDataFrame(data, VECTORS)
    found, visits = S.search(df.filter("id % 50 = 0"), df, 7, group_col="repo" if grouped else None)
    queries = [x for x in data if x[0] % 50 == 0]
    same(found.collect(), by_force(queries, data, 7, grouped))
    share = visits.agg(F.sum("n")).first()[0] / (len(queries) * len(data))
    assert share < 0.45, share


def test_blocks_are_bounded_parts(spark, monkeypatch):
    """With small parts the repeated vector is many tasks, and more queries than
    a part come in several; the result is the same without broadcast."""
    monkeypatch.setattr(S, "PART", 32)
    data = clustered(1200, 8, 400)
    df = spark.createDataFrame(data, VECTORS)
    assigned = S.assign(df.withColumn("grp", F.lit("")).withColumn("vec", F.col("vec").cast("array<double>")), np.eye(8))
    rows, blocks = S.with_blocks(assigned)
    sizes = [r["count"] for r in rows.groupBy("list", "ring", "part").count().collect()]
    assert sum(sizes) == 1200 and max(sizes) <= 64 and blocks.agg(F.max("n")).first()[0] >= 400
    found = S.semantic_topk(df.filter("id % 10 = 0"), df, 3, broadcast_bytes=0)
    same(found.collect(), by_force([x for x in data if x[0] % 10 == 0], data, 3, False))


def test_rows_without_direction_take_no_part(spark):
    data = [(1, "a", [1.0, 0.0]), (2, "a", [0.0, 2.0]), (3, None, [3.0, 0.5]), (4, "a", None), (5, "a", [0.0, 0.0]),
            (6, "a", [1.0, None]), (7, "a", [float("nan"), 1.0]), (8, "a", [1.0, 2.0, 3.0]), (None, "a", [1.0, 1.0]),
            (9, "b", [-1.0, 0.0]), (10, "a", [])]
    df = spark.createDataFrame(data, VECTORS)
    got = sorted(tuple(r)[:3] for r in S.semantic_topk(df, df, 2).collect())
    assert got == [(1, 1, 3), (1, 2, 2), (2, 1, 3), (2, 2, 1), (3, 1, 1), (3, 2, 2), (9, 1, 2), (9, 2, 3)]
    grouped = sorted(tuple(r)[:3] for r in S.semantic_topk(df, df, 2, group_col="repo").collect())
    assert grouped == [(1, 1, 2), (2, 1, 1)]
    none = spark.createDataFrame([], VECTORS)
    assert S.semantic_topk(none, none).count() == 0 and S.semantic_topk(df, none).count() == 0


def test_hybrid_sources_and_positions(spark):
    ranked = spark.createDataFrame([(1, "r", "a.py", 2, 0.5), (1, "r", "a.py", 1, 0.9), (1, "r", "b.py", 3, 0.4), (1, "r", "c.py", 2, 0.8)],
                                   "issue_id long, repo string, path string, rank int, similarity double")
    keyword = spark.createDataFrame([(1, "r", "z.py"), (1, "r", "b.py"), (1, "r", "b.py"), (2, "r", "k.py"), (2, "r", None)],
                                    "issue_id long, repo string, path string")
    fallback = spark.createDataFrame([(1, "r", "f.py"), (2, "r", "k.py"), (2, "r", "e.py"), (3, "r", "g.py")],
                                     "issue_id long, repo string, path string")
    got = S.hybrid_candidates(ranked, keyword, fallback).orderBy("issue_id", "position").collect()
    assert [(r.issue_id, r.path, r.source, r.rank, r.position) for r in got] == [
        (1, "b.py", "both", 3, 1), (1, "a.py", "semantic", 1, 2), (1, "c.py", "semantic", 2, 3), (1, "z.py", "keyword", None, 4),
        (2, "k.py", "keyword", None, 1), (2, "e.py", "fallback", None, 2), (3, "g.py", "fallback", None, 1)]
    assert S.hybrid_candidates(ranked, keyword).filter("source = 'fallback'").count() == 0
