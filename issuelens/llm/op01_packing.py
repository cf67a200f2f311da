"""Conflict-constrained best-fit packing of documents into training bins.

A document of more words than a bin holds is cut into full pieces and a rest.
Bins of a lane are kept ordered by what they still hold; a piece goes to the
tightest bin that fits and does not conflict: the search starts at the first
bin with room and moves to its successors.  A bin carries bitmaps of its
duplicate clusters (at most one document of a cluster) and of its sources
(``per_source`` bit planes: at most so many pieces of a source).  Pieces are
placed by falling size.

Lanes hold some ``lane_docs`` pieces dealt by a hash, so a source or cluster
with a third of all rows is spread over all of them, and so are rows without
an id and repeated rows; only ids and sizes are
shuffled.  Every piece is placed; reruns agree.

Cases: a null or empty text is one piece of no words; null sources are one
source; a null cluster conflicts with nothing; repeated rows are separate
documents (of one cluster in the query); an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, text_of, with_place, words

SCHEMA = ("doc_id {id}, piece int, start_word bigint, n_words bigint, source string, bin bigint, slot int, "
          "bin_words bigint, bin_pieces int")


def best_fit(pieces: list[tuple], capacity: int, per_source: int) -> tuple[list[int], list[int]]:
    """Bin and place in the bin of every piece (size, source, cluster); the
    pieces come by falling size."""
    order: list[tuple[int, int]] = []  # (room, bin), ascending
    clusters: list[int] = []
    planes: list[list[int]] = []
    counts: list[int] = []
    source_bit: dict = {}
    cluster_bit: dict = {}
    bins, slots = [], []
    for size, source, cluster in pieces:
        s = 1 << source_bit.setdefault(source, len(source_bit))
        c = 0 if cluster is None else 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        at = bisect_left(order, (size, -1))
        while at < len(order):
            b = order[at][1]
            if not clusters[b] & c and not planes[b][-1] & s:
                break
            at += 1
        if at < len(order):
            room, b = order.pop(at)
        else:
            room, b = capacity, len(clusters)
            clusters.append(0)
            planes.append([0] * per_source)
            counts.append(0)
        clusters[b] |= c
        for k, plane in enumerate(planes[b]):  # the first plane without the source's bit
            if not plane & s:
                planes[b][k] |= s
                break
        insort(order, (room - size, b))
        bins.append(b)
        slots.append(counts[b])
        counts[b] += 1
    return bins, slots


def text_cluster(text: Column) -> Column:
    """Cluster of documents with the same words (case and spacing aside)."""
    return F.md5(F.concat_ws(" ", words(F.lower(text))))


def pack(docs: DataFrame, cluster: Column, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         capacity: int = 2048, per_source: int = 4, lane_docs: int = 4096) -> DataFrame:
    """One row per piece: its words, its bin and its place in the bin."""
    lanes = max(1, -(-docs.select(id_col).count() // lane_docs))
    d = with_place(docs, F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                   F.size(words(text_of(text_col))).cast("bigint").alias("_n"), cluster.alias("cluster"))
    last = F.greatest(F.ceil(F.col("_n") / capacity) - 1, F.lit(0))
    p = d.select("doc_id", "source", "cluster", "_n", "_place", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("k")).select(
        "doc_id", "source", "cluster", "_place", F.col("k").cast("int").alias("piece"), (F.col("k") * capacity).alias("start_word"),
        F.least(F.lit(capacity).cast("bigint"), F.col("_n") - F.col("k") * capacity).alias("n_words"))
    # Rows without an id are dealt apart by their cluster and source, equal
    # rows by their place among each other; ties inside a lane are broken by
    # all fields.
    p = p.withColumn("lane", F.pmod(F.xxhash64("doc_id", "piece", "source", "cluster", "_place"), F.lit(lanes)))

    def lane(key, t):
        t = t.sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("piece", "ascending"),
                       ("source", "ascending"), ("cluster", "ascending")])
        cols = [t.column(c).to_pylist() for c in ("n_words", "source", "cluster")]
        bins, slots = best_fit(list(zip(*cols)), capacity, per_source)
        fill, n = {}, {}
        for b, size in zip(bins, cols[0]):
            fill[b] = fill.get(b, 0) + size
            n[b] = n.get(b, 0) + 1
        first = key[0].as_py() << 24
        return pa.table({
            "doc_id": t.column("doc_id"), "piece": t.column("piece"), "start_word": t.column("start_word"),
            "n_words": t.column("n_words"), "source": t.column("source"),
            "bin": pa.array([first + b for b in bins], pa.int64()), "slot": pa.array(slots, pa.int32()),
            "bin_words": pa.array([fill[b] for b in bins], pa.int64()),
            "bin_pieces": pa.array([n[b] for b in bins], pa.int32())})
    return p.groupBy("lane").applyInArrow(lane, SCHEMA.format(id=dict(d.dtypes)["doc_id"]))


def op1_packing(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents"), text_cluster(text_of()))
