"""Near-duplicate documents: MinHash bands, Bayesian pruning, exact links.

1. Each text's set of shingles gives a MinHash signature and band keys (one
   Arrow pass).  Documents with equal sets are one class, held by its smallest
   id, so copies cost one row from here on.
2. Classes that share a band key are candidates: each points to the smallest
   class of its key (never a list of pairs), and the connected components of
   these edges are the rough groups.  No similar pair leaves its rough group
   unless all bands miss it (below 2e-7 at the threshold with 40 x 5).
3. Inside a group the signatures are compared in batches; a pair is dropped
   once the posterior probability that it reaches the threshold falls below
   ``miss``.  Survivors are verified on the full sets, most similar first,
   and pairs that are connected already are skipped.
4. Groups above ``group_rows`` classes (or ``group_shingles``) are cut into
   chunks.  Two passes with different chunks join what meets; then every class
   outside the group's largest component so far is compared with all classes
   of its group that share a band key with it, block by block.  So each pair of
   a group that shares a key is either connected or compared, no task holds
   more than two chunks, and no pairs are written.

Cases: texts without words (or null) have an empty set and are linked with
nothing; rows that share an id share a component (links are verified on the
smallest of their texts); a null id is never linked; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, read
from .components import components
from .hashing import Prefix, mix

BANDS, ROWS = 40, 5
BATCH = 40
SLICE_BYTES = 1 << 20
SALTS = 16  # parts into which a band key is dealt in the strays' join
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text."""
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    part, size = [], 0
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass").lower() if t else b""
        part.append((i, raw))
        size += len(raw) + 1
        if size > SLICE_BYTES or i == len(texts) - 1:
            _slice_sets(part, k, out)
            part, size = [], 0
    return out


def _slice_sets(part: list[tuple[int, bytes]], k: int, out: list[np.ndarray]) -> None:
    buf = np.frombuffer(b" " + b" ".join(raw for _, raw in part) + b" ", np.uint8)
    gap = _SPACES[buf]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    words = Prefix(buf).of(starts, ends)
    offsets = np.cumsum([1] + [len(raw) + 1 for _, raw in part])
    at = np.searchsorted(starts, offsets)
    for (i, _), a, b in zip(part, at[:-1], at[1:]):
        if b > a:
            w = words[a:b]
            n = min(k, len(w))
            h = w[:len(w) - n + 1].copy()
            for j in range(1, n):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[j:len(w) - n + 1 + j])
            out[i] = np.unique(h)


@lru_cache(maxsize=2)
def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20_24)
    return r.integers(1, 1 << 32, n, dtype=np.uint32) | np.uint32(1), r.integers(0, 1 << 32, n, dtype=np.uint32)


def signature(hashes: np.ndarray) -> np.ndarray:
    a, b = _family(BANDS * ROWS)
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 2048):
        np.minimum(best, (h[i:i + 2048, None] * a + b).min(axis=0), out=best)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for c in sig.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + c)
    return key.astype(np.int64)


@lru_cache(maxsize=4)
def least_matches(percent: int, miss: float) -> list[int]:
    """Per compared batch the least number of equal signature bytes that a
    pair needs: below it P(similarity >= threshold | matches) < ``miss`` under
    a uniform prior (signature bytes agree by chance in 1 of 256)."""
    s = (np.arange(4000) + 0.5) / 4000
    c = np.log(s + (1 - s) / 256), np.log1p(-(s + (1 - s) / 256))
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        for m in range(n + 1):
            ll = m * c[0] + (n - m) * c[1]
            p = np.exp(ll - ll.max())
            if p[s >= percent / 100].sum() >= miss * p.sum():
                out.append(m)
                break
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class Labels:
    """Union-find over positions; the smallest id names a set."""

    def __init__(self, labels: np.ndarray):
        self.up = list(range(len(labels)))
        first: dict = {}
        for i, x in enumerate(labels.tolist()):
            self.join(i, first.setdefault(x, i))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def link_group(labels: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], percent: int, miss: float,
               asked: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (positions) that join members of different labels.  ``asked``:
    only pairs with such a member are compared."""
    n = len(labels)
    sizes = np.array([len(s) for s in sets])
    state, links = Labels(labels), []
    least = least_matches(percent, miss)
    for block in range(0, n, 128):  # rows of the pair matrix, so that a block of pairs stays small
        rows = np.arange(block, min(n, block + 128))
        if asked is not None:
            rows = rows[asked[rows]]
        if not len(rows):
            continue
        i = np.repeat(rows, n)
        j = np.tile(np.arange(n), len(rows))
        keep = (labels[i] != labels[j]) & (100 * np.minimum(sizes[i], sizes[j]) >= percent * np.maximum(sizes[i], sizes[j]))
        keep &= (j > i) if asked is None else ((j > i) | ~asked[j])
        i, j = i[keep], j[keep]
        matches = np.zeros(len(i), np.int64)
        for b, need in enumerate(least):
            at = slice(b * BATCH, (b + 1) * BATCH)
            matches += (sigs[i, at] == sigs[j, at]).sum(axis=1)
            keep = matches >= need
            i, j, matches = i[keep], j[keep], matches[keep]
        for x in np.argsort(-matches, kind="stable"):
            p, q = int(i[x]), int(j[x])
            if state.find(p) != state.find(q) and similar(sets[p], sets[q], percent):
                state.join(p, q)
                links.append((p, q))
    return links


def _signed(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, bands) per row."""
    def run(batches):
        for b in batches:
            ids, n, key, bands = b.column(0), [], [], []
            sets = shingle_sets(b.column(1).to_pylist(), k)
            for i, s in enumerate(sets):
                n.append(len(s))
                if len(s) and ids[i].is_valid:
                    x = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
                    key.append(b"%d:%d:%d" % (len(s), x[0], x[1]))
                    bands.append(band_keys(signature(s)))
                else:
                    key.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_id", "bands"])
    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles bigint, set_id binary, bands array<bigint>")


def _members(docs: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """(comp, chunks, id, sig, shingles) of the classes in rough groups."""
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(groups, "id") \
        .groupBy("id", "comp", "chunks").agg(F.min("text").alias("text")).select("comp", "chunks", "id", "text")

    def run(batches):
        for b in batches:
            sets = shingle_sets(b.column(3).to_pylist(), k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([signature(s).astype(np.uint8).tobytes() for s in sets], pa.binary()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], ["comp", "chunks", "id", "sig", "shingles"])
    return rows.mapInArrow(run, "comp bigint, chunks bigint, id bigint, sig binary, shingles binary")


def _grouped(rows: DataFrame, keys: list[str], percent: int, miss: float, links: bool) -> DataFrame:
    """Rows (id, label, asked, sig, shingles) of each key compared.  ``links``:
    the verified links between labels (a, b); else the new label of each id."""
    def run(t):
        t = t.sort_by("id")
        ids, labels = t.column("id").to_numpy(), t.column("label").to_numpy()
        sigs = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
        sets = [np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()]
        asked = t.column("asked").to_numpy(zero_copy_only=False)
        found = link_group(labels, sigs, sets, percent, miss, None if asked.all() else asked)
        if links:
            return pa.table({"a": pa.array([labels[p] for p, _ in found], pa.int64()),
                             "b": pa.array([labels[q] for _, q in found], pa.int64())})
        state = Labels(labels)
        for p, q in found:
            state.join(p, q)
        return pa.table({"id": t.column("id"), "label": pa.array([ids[state.find(i)] for i in range(len(ids))], pa.int64())})
    rows = rows.select(*keys, "id", "label", "asked", "sig", "shingles").groupBy(*keys)
    return rows.applyInArrow(run, "a bigint, b bigint" if links else "id bigint, label bigint")


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label) after joining the labels that the links (a, b) connect."""
    c = components(links).withColumnRenamed("node", "label")
    return labels.join(c, "label", "left").select("id", F.coalesce("component", "label").alias("label"))


def _strays(big: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, comp, label, stray) of the large groups: a stray is outside the
    largest component of its group so far.  The largest component of a group
    is joined on (group, chunk), repeated per chunk, so a large group is no
    hot key; only ids and labels are joined."""
    now = cut(big.select("id", "comp", "chunks").join(labels, "id"))
    main = now.groupBy("comp", "chunks", "label").count().groupBy("comp", "chunks").agg(
        F.max(F.struct("count", "label"))["label"].alias("main"))
    main = main.select("comp", "main", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"))
    return now.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks"))).join(main, ["comp", "chunk"]) \
        .select("id", "comp", "label", (F.col("label") != F.col("main")).alias("stray"))


def _late_links(members: DataFrame, at: DataFrame, bands: DataFrame, percent: int, miss: float, group_rows: int,
                group_shingles: int) -> DataFrame:
    """Links (a, b) between labels that the strays still have: a stray meets
    the classes of its group that share a band key with it, in blocks of two
    times ``group_rows`` classes (or ``group_shingles``).  Keys without a stray or with one label are
    left out, so what is compared follows the buckets of the keys, not the
    square of the group."""
    keyed = cut(at.join(bands, "id").select("id", "label", "stray", "n_shingles", F.explode("bands").alias("key")))

    def blocks(which):
        return F.greatest(F.ceil(F.count_if(which) / group_rows),
                          F.ceil(F.sum(F.when(which, F.col("n_shingles"))) / group_shingles))
    facts = keyed.groupBy("key").agg(
        blocks(F.lit(True)).alias("parts"), blocks(F.col("stray")).alias("sides"),
        (F.min("label") != F.max("label")).alias("open")).filter("open AND sides > 0").drop("open")
    facts = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    due = keyed.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SALTS)).cast("int")).join(facts, ["key", "salt"])
    side, part = F.pmod(F.xxhash64("id", F.lit(2)), F.col("sides")), F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts"))

    def every(n):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    cols = ["id", "label", "key", "side", "part", "asked"]
    ask = due.filter("stray").withColumn("asked", F.lit(True)).withColumn("side", side).withColumn("part", every("parts"))
    told = due.withColumn("asked", F.lit(False)).withColumn("part", part).withColumn("side", every("sides"))
    return _grouped(ask.select(*cols).unionByName(told.select(*cols)).join(members.select("id", "sig", "shingles"), "id"),
                    ["key", "side", "part"], percent, miss, links=True)


def _group_labels(members: DataFrame, bands: DataFrame, percent: int, miss: float, group_rows: int,
                  group_shingles: int) -> DataFrame:
    """(id, label): the components inside the rough groups."""
    def chunk(salt):
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.col("chunks"))
    first = members.withColumn("asked", F.lit(True)).withColumn("chunk", chunk(0)).withColumn("label", F.col("id"))
    labels = cut(_grouped(first, ["comp", "chunk"], percent, miss, links=False))
    big = members.filter("chunks > 1")
    if not big.select("id").take(1):
        return labels
    # Second chunking of the large groups, then whatever is outside the
    # largest component of its group against the classes it shares a key with.
    again = _grouped(big.join(labels, "id").withColumn("asked", F.lit(True)).withColumn("chunk", chunk(1)),
                     ["comp", "chunk"], percent, miss, links=True)
    labels = cut(_relabelled(labels, again))
    at = cut(_strays(big, labels))
    if not at.filter("stray").take(1):
        return labels
    late = cut(_late_links(big, at, bands, percent, miss, group_rows, group_shingles))
    return _relabelled(labels, late) if late.take(1) else labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, percent: int = 80,
                    miss: float = 1e-6, group_rows: int = 512, group_shingles: int = 2_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; ids are integers."""
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = cut(_signed(d, k))
    classes = cut(signed.filter(F.col("set_id").isNotNull()).groupBy("set_id").agg(
        F.min(F.struct("doc_id", "n_shingles", "bands")).alias("c")).select("set_id", "c.*"))
    keyed = classes.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"))
    roots = keyed.groupBy("key").agg(F.min("id").alias("root"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rough = components(keyed.join(roots, "key").select(F.col("id").alias("a"), F.col("root").alias("b")))
    rough = rough.join(classes.select(F.col("doc_id").alias("node"), "n_shingles"), "node")
    size = rough.groupBy("component").agg(F.greatest(
        F.ceil(F.count("*") / group_rows), F.ceil(F.sum("n_shingles") / group_shingles)).alias("chunks"))
    groups = rough.join(size, "component").select(F.col("component").alias("comp"), "chunks", F.col("node").alias("id"))
    final = _group_labels(cut(_members(d, groups, k)), classes.select(F.col("doc_id").alias("id"), "n_shingles", "bands"),
                          percent, miss, group_rows, group_shingles).withColumnRenamed("id", "rep")
    ids = classes.select("set_id", F.col("doc_id").alias("rep")).join(final, "rep", "left") \
        .select("set_id", F.coalesce("label", "rep").alias("component_id"))
    # Empty sets get a key of their own, so they are no hot null key.
    own = F.coalesce("set_id", F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    out = signed.select("doc_id", "n_shingles", own.alias("set_id")).join(ids, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op8_minhash(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents")).withColumn(
        "kept", F.col("doc_id") == F.col("component_id"))
