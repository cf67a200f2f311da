"""Mixing sources to target weights by pivotal dependent rounding
(DataFrame functions only).

Each source gets a target number of words (weights in cyclic order over the
sources, water-filled under a ceiling of ``ceiling`` times its size).  A
document of a source is wanted ``target / source_size`` times: the whole part
is certain, the fraction is a copy probability.  Pairs of fractional
documents exchange mass (words) at random until one of them is whole; what
is left of a block of documents is one fractional document, and these
residuals meet in the blocks of the next tree level until one per source is
left.  The words taken from a source so differ from its target by less than
one document, whatever its size.

Randomness is a hash of id, level and seed: reruns agree.  Cases: null text
has size 0 and is never counted; a null source is a source of its own (last
in order); repeated ids are rounded row by row; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, read, text_of, with_place, words

#: Weights of the sources in code-point order, repeating (fixed by the task).
WEIGHTS = (3, 1, 2)
BLOCK = 64


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """(source, source_size, n_docs, target) from rows (source, size).

    The windows run over one row per source, not over documents."""
    s = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"),
                                    F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    s = s.withColumn("_w", F.element_at(w, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    every = Window.partitionBy(F.lit(1))
    s = s.withColumn("_cap", F.col("source_size") * ceiling).withColumn("_ratio", F.col("_cap") / F.col("_w")) \
        .withColumn("_want", F.sum("source_size").over(every) * share)
    fill = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(fill.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("_full", F.col("_ratio") <= (F.col("_want") - before) / rest)
    level = (F.col("_want") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(every)) \
        / F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))).over(every)
    s = s.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * level))
    return s.select("source", "source_size", "n_docs", "target")


# One step of the pivotal method inside a block: ``c`` is the fractional
# document carried so far, ``x`` the next.  The words c.m + x.m are kept; c
# ends at its lowest or highest possible share, so that one of both is whole.
_STEP = """
(s, x) -> CASE
  WHEN x.p <= 1e-9 OR x.p >= 1 - 1e-9 OR x.size = 0
    THEN struct(s.c AS c, concat(s.done, array(struct(x.id AS id, x.size AS size,
         x.base + CAST(CASE WHEN x.size = 0 THEN x.u < x.p ELSE x.p > 0.5 END AS INT) AS copies))) AS done)
  WHEN s.c IS NULL THEN struct(x AS c, s.done AS done)
  ELSE transform(array(struct(s.c.size * s.c.p + x.size * x.p AS m)), z ->
       transform(array(struct(z.m AS m, greatest(0D, (z.m - x.size) / s.c.size) AS lo,
                              least(1D, z.m / s.c.size) AS hi)), r ->
       transform(array(struct(r.m AS m, CASE WHEN r.hi - r.lo < 1e-12 OR x.u < (s.c.p - r.lo) / (r.hi - r.lo)
                                             THEN r.hi ELSE r.lo END AS p)), q ->
       transform(array(struct(q.p AS p, greatest(0D, least(1D, (q.m - s.c.size * q.p) / x.size)) AS xp)), y ->
         CASE WHEN y.p <= 1e-9 OR y.p >= 1 - 1e-9 THEN
           struct(CASE WHEN y.xp <= 1e-9 OR y.xp >= 1 - 1e-9 THEN CAST(NULL AS {item})
                  ELSE struct(x.u AS u, x.id AS id, x.size AS size, x.base AS base, y.xp AS p) END AS c,
             concat(s.done, array(struct(s.c.id AS id, s.c.size AS size, s.c.base + CAST(y.p > 0.5 AS INT) AS copies)),
               CASE WHEN y.xp <= 1e-9 OR y.xp >= 1 - 1e-9
                    THEN array(struct(x.id AS id, x.size AS size, x.base + CAST(y.xp > 0.5 AS INT) AS copies))
                    ELSE CAST(array() AS array<{done}>) END) AS done)
         ELSE
           struct(struct(s.c.u AS u, s.c.id AS id, s.c.size AS size, s.c.base AS base, y.p AS p) AS c,
             concat(s.done, array(struct(x.id AS id, x.size AS size, x.base + CAST(y.xp > 0.5 AS INT) AS copies))) AS done)
         END)[0])[0])[0])[0]
END"""


def _round_blocks(items: DataFrame, id_type: str) -> DataFrame:
    """Fold every block: ``done`` (rounded documents) and ``c`` (the one
    still fractional, or null)."""
    item = f"struct<u:double,id:{id_type},size:bigint,base:int,p:double>"
    done = f"struct<id:{id_type},size:bigint,copies:int>"
    fold = f"aggregate(items, struct(CAST(NULL AS {item}) AS c, CAST(array() AS array<{done}>) AS done), " \
        + _STEP.format(item=item, done=done) + ")"
    return items.groupBy("source", "source_size", "target", "block").agg(
        F.sort_array(F.collect_list(F.struct("u", "id", "size", "base", "p"))).alias("items")) \
        .select("source", "source_size", "target", "block", F.expr(fold).alias("f"))


def round_copies(sizes: DataFrame, targets: DataFrame, seed: int = 7, ceiling: float = 2.0) -> DataFrame:
    """Copies per row of ``sizes`` (doc_id, source, size): doc_id, source,
    size, source_size, target, copies."""
    id_type = dict(sizes.dtypes)["doc_id"]
    t = targets.select(F.col("source").alias("_s"), "source_size", "target", "n_docs")

    def uniform(level):
        return F.pmod(F.xxhash64(F.col("id"), F.lit(level), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)

    f = F.when(F.col("source_size") > 0, F.least(F.lit(ceiling), F.col("target") / F.col("source_size"))).otherwise(0.0)
    rows = sizes.join(t, F.col("source").eqNullSafe(F.col("_s"))).withColumnRenamed("doc_id", "id") \
        .withColumn("_f", f).select(
            "source", "source_size", "target", "id", F.col("size").cast("bigint").alias("size"),
            F.floor(F.col("_f") + 1e-12).cast("int").alias("base"),
            F.greatest(F.lit(0.0), F.col("_f") - F.floor(F.col("_f") + 1e-12)).alias("p"),
            uniform(0).alias("u"), F.pmod(F.xxhash64("id", F.lit(seed + 1)),
                                          F.ceil(F.col("n_docs") / BLOCK)).alias("block"))
    blocks = targets.agg(F.ceil(F.max("n_docs") / BLOCK)).first()[0] or 1
    done, level = [], 0
    while True:
        folded = cut(_round_blocks(rows, id_type))
        done.append(folded.select("source", "source_size", "target", F.explode("f.done").alias("d"))
                    .select("source", "source_size", "target", "d.*"))
        left = folded.filter(F.col("f.c").isNotNull()).select("source", "source_size", "target", "block", "f.c.*")
        if blocks <= 1:
            break
        level, blocks = level + 1, -(-blocks // BLOCK)
        rows = left.withColumn("block", F.floor(F.col("block") / BLOCK)).withColumn("u", uniform(level))
    # The root: one fractional document per source at most.
    done.append(left.select("source", "source_size", "target", "id", "size",
                            (F.col("base") + (uniform(-1) < F.col("p")).cast("int")).alias("copies")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = 1.5, ceiling: float = 2.0, seed: int = 7) -> DataFrame:
    """Copies of every document so that the sources' words come near their targets."""
    rows = with_place(docs, F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                      F.size(words(text_of(text_col))).cast("bigint").alias("size"), F.xxhash64(text_of(text_col)).alias("text"))
    # The rounding tells rows without an id and repeated rows apart.
    sizes = cut(rows.select(F.struct("doc_id", F.xxhash64("text", "_place").alias("row")).alias("doc_id"), "source", "size"))
    targets = cut(source_targets(sizes, weights, share, ceiling))
    copies = round_copies(sizes, targets, seed, ceiling)
    return copies.withColumn("doc_id", F.col("doc_id.doc_id"))


def op4_mixing(spark, sf_dir):
    return mix(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", F.col("source_size").cast("bigint").alias("source_size"), "target",
        (F.col("copies") * F.col("size")).cast("bigint").alias("taken"), "source", "copies")
