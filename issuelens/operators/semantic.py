"""Semantic file retrieval (R1) and the hybrid candidate set (R2).

``semantic_topk`` is an exact nearest-neighbour search over given embeddings.
Index: centres are fitted on a bounded sample (``SAMPLE`` rows by a hash of the
id); every chunk is assigned to its nearest centre and, by its distance to
the centre, to one of four rings of that list (cuts from a quantile sketch per
list), so a block (list, ring) has a centre and a range of distances.  Search:
by the triangle inequality no member of a block is nearer to the query than

    max(d(q, c) - hi, lo - d(q, c), 0)

First every query visits its most promising block with ``k`` members, which
bounds the distance of its k-th best; then all other blocks that can still beat
it.  Whatever is skipped cannot be in the result, so the result is exact; how
much is skipped depends on how the embeddings cluster.

Work is dealt by (block, part of the block, part of the queries): at most about
``PART`` rows meet as many queries in one call, a block that holds a third of
all rows (one vector repeated) is many tasks, and only ``k`` rows per query
leave each of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

SAMPLE = 20_000
MAX_LISTS = 1024
PART = 2048
#: Similarities are ranked by this many decimals (ties by id), bounds keep a wider distance.
DECIMALS = 9
SLACK = 1e-6


def _unit(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of length one as a matrix of doubles."""
    x = np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), np.float64)
    x = x.reshape(-1, dim)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _lists(m: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(m.ravel(), pa.float64()), m.shape[1]).cast(pa.list_(pa.float64()))


def usable(vectors: DataFrame, vec: str, dim: int | None = None) -> tuple[DataFrame, int]:
    """The rows that have a direction (no null, NaN or infinite element, not
    all zero) and ``dim`` elements, by default the most frequent length."""
    v = F.col(vec).cast("array<double>")
    x = vectors.withColumn(vec, v)
    square = F.aggregate(vec, F.lit(0.0), lambda s, e: s + e * e)
    good = x.filter(F.coalesce((square > 0) & (square < float("inf")), F.lit(False)))
    if dim is None:
        top = good.groupBy(F.size(vec).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
        dim = top["d"] if top else 1
    return good.filter(F.size(vec) == dim), dim


def fit_centres(chunks: DataFrame, dim: int, sample: int = SAMPLE, rounds: int = 8) -> np.ndarray:
    """Centres of a few rounds of k-means on at most ``sample`` rows; their
    number grows with the root of the table up to ``MAX_LISTS``."""
    n = chunks.count()
    rows = chunks.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(sample).toArrow().column("vec")
    x = _unit(rows, dim)
    lists = max(1, min(MAX_LISTS, math.isqrt(n) // 2))
    c = np.unique(x[:: max(1, len(x) // lists)][:lists], axis=0) if len(x) else np.zeros((1, dim))
    for _ in range(rounds if len(x) else 0):
        near = (x @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)
        used = np.unique(near)
        c = np.stack([x[near == u].mean(axis=0) for u in used])
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * x @ c.T))


def assign(chunks: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, grp, vec, list, dist): unit vector, nearest centre, distance to it."""
    shared = chunks.sparkSession.sparkContext.broadcast(centres)  # at most MAX_LISTS rows

    def run(batches):
        for b in batches:
            x = _unit(b.column("vec"), shared.value.shape[1])
            d = _distances(x, shared.value)
            at = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("grp"), _lists(x), pa.array(at.astype(np.int32)),
                                              pa.array(d[np.arange(len(x)), at])], ["id", "grp", "vec", "list", "dist"])
    return chunks.select("id", "grp", "vec").mapInArrow(run, "id bigint, grp string, vec array<double>, list int, dist double")


def with_blocks(assigned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with ring and part, blocks (grp, list, ring, n, lo, hi, parts))."""
    cuts = assigned.groupBy("grp", "list").agg(F.percentile_approx("dist", [0.25, 0.5, 0.75], 200).alias("cuts"))
    ring = F.size(F.filter("cuts", lambda c: F.col("dist") > c))
    rows = assigned.join(cuts, ["grp", "list"]).withColumn("ring", ring).drop("cuts").checkpoint()
    blocks = rows.groupBy("grp", "list", "ring").agg(
        F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi"),
        F.ceil(F.count("*") / PART).cast("int").alias("parts")).checkpoint()
    rows = rows.join(blocks.select("grp", "list", "ring", "parts"), ["grp", "list", "ring"]) \
        .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    return rows, blocks


def _to_centres(queries: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, grp, vec, cd): unit vector and its distance to every centre."""
    shared = queries.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for b in batches:
            x = _unit(b.column("vec"), shared.value.shape[1])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("grp"), _lists(x), _lists(_distances(x, shared.value))],
                                             ["id", "grp", "vec", "cd"])
    return queries.select("id", "grp", "vec").mapInArrow(run, "id bigint, grp string, vec array<double>, cd array<double>")


BLOCK = ["grp", "list", "ring"]


def _best(visits: DataFrame, queries: DataFrame, rows: DataFrame, k: int, dim: int) -> DataFrame:
    """(query_id, id, similarity): the best ``k`` of each visited part."""
    places = visits.select("query_id", "qpart", *BLOCK, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    key = [*BLOCK, "part", "qpart"]
    asked = places.join(queries.select(F.col("id").alias("query_id"), F.col("vec").alias("qvec")), "query_id")
    needed = places.select(*[F.col(c).alias(f"m_{c}") for c in key]).distinct()
    members = rows.join(needed, [F.col(c) == F.col(f"m_{c}") for c in (*BLOCK, "part")]).select(*needed.columns, "id", "vec")

    def meet(q: pa.Table, m: pa.Table) -> pa.Table:
        out: dict = {"query_id": [], "id": [], "similarity": []}
        if q.num_rows and m.num_rows:
            m = m.sort_by("id")
            ids, x = np.asarray(m.column("id")), _unit(m.column("vec"), dim)
            for at in range(0, q.num_rows, PART):
                part = q.slice(at, PART)
                own = np.asarray(part.column("query_id"))
                s = np.round(_unit(part.column("qvec"), dim) @ x.T, DECIMALS)
                s[own[:, None] == ids[None, :]] = -np.inf
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                value = np.take_along_axis(s, top, axis=1)
                good = value > -np.inf
                out["query_id"].append(np.repeat(own, top.shape[1])[good.ravel()])
                out["id"].append(ids[top.ravel()][good.ravel()])
                out["similarity"].append(value.ravel()[good.ravel()])
        return pa.table({c: pa.array(np.concatenate(v) if v else [], pa.float64() if c == "similarity" else pa.int64())
                         for c, v in out.items()})
    return asked.groupBy(*key).cogroup(members.groupBy(*needed.columns)).applyInArrow(meet, "query_id bigint, id bigint, similarity double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def semantic_topk(queries: DataFrame, chunks: DataFrame, k: int = 10, id_col: str = "id", vec_col: str = "vec",
                  group_col: str | None = None, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """For every query the ``k`` chunks of largest cosine similarity
    (rounded to nine decimals; ties: the smallest id), itself excluded, among
    those of its group if a group column (repository) is given.

    Returns ``(query_id, rank, id, similarity)``.  Rows without a direction
    take no part; a query in a group without chunks has no rows.
    """
    found, _ = search(queries, chunks, k, id_col, vec_col, group_col, broadcast_bytes)
    return found


def search(queries, chunks, k, id_col="id", vec_col="vec", group_col=None, broadcast_bytes=32 << 20):
    """``semantic_topk`` and its visits (query_id, n, parts of blocks)."""
    ensure_checkpoint_dir(chunks.sparkSession)

    def shaped(df, dim):
        grp = F.col(group_col).cast("string") if group_col else F.lit("")
        good, dim = usable(df.select(F.col(id_col).cast("bigint").alias("id"), grp.alias("grp"), F.col(vec_col).alias("vec")), "vec", dim)
        return good.filter("id IS NOT NULL AND grp IS NOT NULL"), dim
    members, dim = shaped(chunks, None)
    asked, _ = shaped(queries, dim)
    centres = fit_centres(members, dim)
    rows, blocks = with_blocks(assign(members, centres))
    asked = _to_centres(asked, centres).checkpoint()
    qparts = max(1, asked.count() // PART)
    size = blocks.count() * 64
    sized = F.broadcast(blocks) if size <= broadcast_bytes else blocks
    far = F.get("cd", F.col("list"))
    bounds = asked.select(F.col("id").alias("query_id"), "grp", "cd").join(sized, "grp").select(
        "query_id", *BLOCK, "n", "parts", F.pmod(F.xxhash64("query_id"), F.lit(qparts)).cast("int").alias("qpart"),
        F.greatest(far - F.col("hi"), F.col("lo") - far, F.lit(0.0)).alias("least"), far.alias("far"))
    # One row per query: its most promising block with k members besides itself.
    first = bounds.filter(F.col("n") > k).groupBy("query_id").agg(
        F.min(F.struct("least", "far", *BLOCK, "parts", "qpart", "n")).alias("b")).select(
        "query_id", *[F.col(f"b.{c}").alias(c) for c in (*BLOCK, "parts", "qpart", "n")]).checkpoint()
    one = _ranked(_best(first, asked, rows, k, dim), k).checkpoint()
    # Squared distance of unit vectors: 2 - 2 * similarity.
    limit = one.filter(F.col("rank") == k).select("query_id", F.sqrt(F.greatest(2 - 2 * F.col("similarity"), F.lit(0.0))).alias("limit"))
    rest = bounds.join(limit, "query_id", "left").join(first.select("query_id", *BLOCK), ["query_id", *BLOCK], "left_anti") \
        .filter(F.col("limit").isNull() | (F.col("least") <= F.col("limit") + SLACK)) \
        .select("query_id", *BLOCK, "parts", "qpart", "n").checkpoint()
    two = _best(rest, asked, rows, k, dim)
    found = _ranked(one.select("query_id", "id", "similarity").unionByName(two), k)
    visits = first.select("query_id", "n").unionByName(rest.select("query_id", "n"))
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", "similarity"), visits


def hybrid_candidates(ranked: DataFrame, keyword: DataFrame, fallback: DataFrame | None = None,
                      keys=("issue_id", "repo")) -> DataFrame:
    """R2: one candidate set from a ranked stream (keys, path, rank,
    similarity: R1) and an unranked one (keys, path: A1 or its mentions).

    Each (issue, path) appears once, tagged ``semantic``, ``keyword`` or
    ``both``; ``position`` is 1 for the path named by both streams with the
    best rank, then the ranked ones by rank, then the unranked by path.  An
    issue whose ranked side is empty takes the ``fallback`` rows (keys, path)
    as well, tagged ``fallback`` where no other stream has them.

    The streams are merged by an aggregate on (issue, path) (partial and
    final), so several chunks of a file count once, with their best rank.
    """
    keys = list(keys)
    none = F.lit(None)

    def tagged(df, tag):
        rank = F.col("rank").cast("bigint") if tag == "semantic" else none.cast("bigint")
        sim = F.col("similarity") if tag == "semantic" else none.cast("double")
        return df.select(*keys, "path", rank.alias("rank"), sim.alias("similarity"), F.lit(tag).alias("tag"))
    every = tagged(ranked, "semantic").unionByName(tagged(keyword, "keyword"))
    if fallback is not None:
        have = ranked.filter("path IS NOT NULL").select(*keys).distinct()
        every = every.unionByName(tagged(fallback.join(have, keys, "left_anti"), "fallback"))
    has = {t: F.bool_or(F.col("tag") == t) for t in ("semantic", "keyword")}
    merged = every.filter("path IS NOT NULL").groupBy(*keys, "path").agg(
        F.min("rank").alias("rank"), F.max("similarity").alias("similarity"), has["semantic"].alias("_s"), has["keyword"].alias("_k"))
    source = F.when(F.col("_s") & F.col("_k"), "both").when(F.col("_s"), "semantic").when(F.col("_k"), "keyword").otherwise("fallback")
    tier = F.when(F.col("_s") & F.col("_k"), 0).when(F.col("_s"), 1).when(F.col("_k"), 2).otherwise(3)
    w = Window.partitionBy(*keys).orderBy(tier, F.col("rank").asc_nulls_last(), "path")
    return merged.withColumn("source", source).withColumn("position", F.row_number().over(w).cast("bigint")) \
        .select(*keys, "path", "source", "rank", "similarity", "position")
