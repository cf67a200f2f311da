"""Connected components over an edge table (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _both(e: DataFrame) -> DataFrame:
    return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) from edges (a, b): component is the smallest node
    reachable.  Alternates two star steps, each a minimum per node (combined
    before the shuffle) and a join, until no edge changes; a node with very
    many edges is a skewed join side, which Spark splits.  Isolated nodes are
    not listed."""
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .filter("a <> b").distinct())
    state = None
    while True:
        # Large star: neighbours above a node point to the smallest near it.
        n = _both(e)
        m = n.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        e = n.filter("b > a").join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        # Small star: a node and its neighbours below point to the smallest.
        m = e.groupBy("a").agg(F.min("b").alias("m"))
        e = cut(e.join(m, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.*").filter("a <> b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node")))
