"""SimHash document fingerprints and Hamming search (DataFrame functions only).

A document's terms are its pairs of neighbouring words (the last word alone),
weighted by length (short terms are common) and counted as often as they occur.  Every
term's 128-bit hash votes with its weight on each bit; the fingerprint has the
bits with a positive vote.  Votes are summed three to a BIGINT (21 bits each),
over chunks of at most 2^18 terms so that no counter overflows, and the chunks
are added bit by bit.

Search: with ``blocks`` blocks and radius r, two fingerprints within r differ
in at most r blocks, so they agree in ``blocks - r`` of them: one permuted
table per choice of agreeing blocks finds every pair, and the distance test
follows.  Equal fingerprints are one entry with a count.

Cases: a null text is empty; equal texts have equal fingerprints; an empty
text has the zero fingerprint; repeated ids (and rows without one, which come
last) follow each other in text order, or in the order of a hash of the text
where they fill more than a bucket; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, read, text_of, words

BITS = 128
LANES = 21  # lanes per half: bits j, j+21, j+42 share one counter, the 64th bit has its own
CHUNK = 1 << 18
_MASK = (1 << 0) | (1 << 21) | (1 << 42)


def terms(text: Column) -> Column:
    """The words of a text in lower case; its terms are the pairs of neighbours."""
    return words(F.lower(text))


def _votes(rows: DataFrame, keys: list[str], words_col: str) -> DataFrame:
    """Fingerprint halves ``hi`` and ``lo`` per ``keys`` of rows with a word array.

    The rows of a key must be in one partition already (one document each):
    the aggregation then needs no exchange of its own beyond the keys'."""
    w = F.col(words_col)
    pair = F.transform(w, lambda x, i: F.struct(
        F.xxhash64(x, F.coalesce(F.get(w, i + 1), F.lit(""))).alias("h"),
        F.when(i + 1 < F.size(w), F.length(x) + F.length(F.get(w, i + 1))).otherwise(F.length(x)).alias("n")))
    t = rows.select(*keys, F.posexplode_outer(pair).alias("_i", "_x")).select(
        *keys, F.coalesce(F.floor(F.col("_i") / CHUNK), F.lit(0)).alias("_chunk"),
        F.col("_x.h").alias("_a"), F.xxhash64("_x.h", F.lit(1)).alias("_b"),
        F.when(F.col("_x.n").isNull(), 0).when(F.col("_x.n") <= 6, 1).when(F.col("_x.n") <= 10, 2).when(F.col("_x.n") <= 14, 3)
        .otherwise(4).cast("bigint").alias("_w"))
    lanes = [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_MASK)) * F.col("_w")).alias(f"{h}{j}")
             for h in ("_a", "_b") for j in range(LANES)]
    top = [F.sum(F.shiftrightunsigned(h, 63) * F.col("_w")).alias(f"{h}63") for h in ("_a", "_b")]
    votes = t.groupBy(*keys, "_chunk").agg(*lanes, *top, F.sum("_w").alias("_n"))
    one = (1 << 21) - 1
    bits = [F.sum(F.shiftright(f"{h}{j}", 21 * k).bitwiseAND(F.lit(one))).alias(f"{h}_{j + 21 * k}")
            for h in ("_a", "_b") for j in range(LANES) for k in range(3)] \
        + [F.sum(f"{h}63").alias(f"{h}_63") for h in ("_a", "_b")]
    total = votes.groupBy(*keys).agg(*bits, F.sum("_n").alias("_n"))

    def half(h):
        x = F.lit(0).cast("bigint")
        for j in range(64):
            bit = F.lit(1 << j if j < 63 else -(1 << 63)).cast("bigint")
            x = x.bitwiseOR(F.when(2 * F.col(f"{h}_{j}") > F.col("_n"), bit).otherwise(F.lit(0).cast("bigint")))
        return x
    return total.select(*keys, half("_a").alias("hi"), half("_b").alias("lo"))


def hamming(hi1, lo1, hi2, lo2) -> Column:
    return F.bit_count(F.col(hi1).bitwiseXOR(F.col(hi2))) + F.bit_count(F.col(lo1).bitwiseXOR(F.col(lo2)))


def likeness(distance: Column) -> Column:
    """1 at equal fingerprints, 0 from half the bits (unrelated texts) on."""
    return F.greatest(F.lit(0.0), 1.0 - 2.0 * distance / BITS)


def printed(hi: str, lo: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(F.col(hi)), 16, "0"), F.lpad(F.hex(F.col(lo)), 16, "0")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hi, lo) of every row; rows of one id and text are one."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("_k"),
                       terms(text_of(text_col)).alias("_w"))
    return _votes(rows, ["doc_id", "_k"], "_w").drop("_k")


def matches(queries: DataFrame, fps: DataFrame, radius: int = 3, blocks: int = 4) -> DataFrame:
    """(hi, lo, fhi, flo, distance, n): per query fingerprint (hi, lo) every
    fingerprint (fhi, flo) of ``fps`` within ``radius`` and its rows.  The
    documents are those of ``fps`` with the fingerprint: equal ones are one
    entry, so groups of copies are not written as pairs.  Exact: every pair
    within the radius agrees in ``blocks - radius`` blocks of one permuted
    table; a pair found in several tables counts in the first one only.
    ``blocks`` is even and divides 128."""
    size = BITS // blocks
    tables = list(combinations(range(blocks), blocks - radius))

    def block(hi, lo, b):
        at = b * size
        c = F.col(hi if at < 64 else lo)
        return F.shiftrightunsigned(c, 64 - at % 64 - size).bitwiseAND(F.lit((1 << size) - 1))

    def keyed(df):
        keys = F.array(*[F.struct(F.lit(n).alias("t"), F.xxhash64(*[block("hi", "lo", b) for b in t]).alias("k"))
                         for n, t in enumerate(tables)])
        return df.select("*", F.explode(keys).alias("_k")).select(*df.columns, F.col("_k.t").alias("t"), F.col("_k.k").alias("k"))

    q = keyed(queries.select("hi", "lo").distinct())
    f = keyed(fps.groupBy("hi", "lo").agg(F.count("*").alias("n"))).select(
        F.col("hi").alias("fhi"), F.col("lo").alias("flo"), "n", "t", "k")
    pairs = q.join(f, ["t", "k"]).filter(hamming("hi", "lo", "fhi", "flo") <= radius)
    agree = []
    for t in tables:
        same = F.lit(True)
        for b in t:
            same = same & (block("hi", "lo", b) == block("fhi", "flo", b))
        agree.append(same)
    first = F.lit(len(tables))
    for n in reversed(range(len(tables))):
        first = F.when(agree[n], n).otherwise(first)
    return pairs.filter(F.col("t") == first).select(
        "hi", "lo", "fhi", "flo", hamming("hi", "lo", "fhi", "flo").alias("distance"), "n")


def within_radius(queries: DataFrame, fps: DataFrame, radius: int = 3, blocks: int = 4) -> DataFrame:
    """Per query fingerprint (hi, lo) what ``matches`` finds: (hi, lo, n_near,
    near), the rows counted and the matching fingerprints as printed, nearest
    first, its own included."""
    m = matches(queries, fps, radius, blocks)
    near = F.sort_array(F.collect_list(F.struct("distance", printed("fhi", "flo").alias("f"))))
    return m.groupBy("hi", "lo").agg(F.sum("n").alias("n_near"), near.alias("near")).select(
        "hi", "lo", "n_near", F.col("near.f").alias("near"))


#: Radius and blocks of the query: 28 tables, two blocks of 16 bits agree.
RADIUS, BLOCKS = 6, 8


#: Rows of one bucket of the id order, values that cut an order on the driver at
#: most, and buckets whose boundary table may be broadcast (32 bytes each).
BUCKET_ROWS, MAX_CUTS, BROADCAST_BUCKETS = 512, 4096, 100_000
#: Buckets of one cut: the rows between two ids' cuts have the last number, the
#: parts of one id's rows the numbers below.
_PARTS = 1 << 32


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (_bucket, _ghost, _r, doc_id, text, next_text): every document with
    the text of the next one by descending id (after the last: the first).

    The ids are cut at quantiles (and evenly between two of them) into buckets
    of some ``BUCKET_ROWS`` rows; rows without an id, or of one id, that fill
    more than a bucket are cut by a hash of their text.  Text is shuffled once,
    by bucket.  The first document of a bucket also goes to the bucket before
    it as a ghost row (``_ghost``), so no window spans more than a bucket.  The
    result does not depend on where the cuts fall."""
    d = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    size = d.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids"), F.percentile_approx(
        "doc_id", [i / MAX_CUTS for i in range(MAX_CUTS + 1)]).alias("c")).first()
    n, found = size["n"], size["c"] or [0]
    n_cuts = max(1, min(MAX_CUTS, -(-n // BUCKET_ROWS)))
    found = [found[i * (len(found) - 1) // n_cuts] for i in range(n_cuts + 1)]
    fine = max(1, -(-n // (BUCKET_ROWS * n_cuts)))
    d = _bucketed(d, found, fine, n, n - size["ids"])
    heads = _before(cut(d.groupBy("_bucket").agg(F.max(F.struct("doc_id", F.bitwise_not("_h").alias("h"))).alias("_head"))))
    if heads.count() <= BROADCAST_BUCKETS:
        heads = F.broadcast(heads)
    ghosts = d.join(heads.withColumnRenamed("_bucket", "_b"), (F.col("_bucket") == F.col("_b"))
                    & F.col("doc_id").eqNullSafe(F.col("_head.doc_id")) & (F.col("_h") == F.bitwise_not("_head.h")))
    # Rows of the head's id are as many as a bucket's: one of them is the ghost.
    ghosts = ghosts.groupBy("_to").agg(F.min(F.struct("text", "doc_id", "_h")).alias("g")).select(
        "g.doc_id", "g.text", F.col("_to").alias("_bucket"), "g._h", F.lit(True).alias("_ghost"))
    rows = d.withColumn("_ghost", F.lit(False)).unionByName(ghosts)
    w = Window.partitionBy("_bucket").orderBy("_ghost", F.col("doc_id").desc_nulls_last(), "_h", "text")
    return rows.select("_bucket", "_ghost", "doc_id", "text", F.row_number().over(w).alias("_r"),
                       F.lead("text").over(w).alias("next_text"))


def _before(heads: DataFrame) -> DataFrame:
    """Adds ``_to``, the next larger bucket (after the largest: the smallest),
    to one row per bucket.  Chunks of the buckets are ordered one by one and
    their first buckets (``MAX_CUTS`` + 1 at most) together."""
    n = heads.count()
    m = max(1, min(MAX_CUTS, -(-n // MAX_CUTS)))
    cuts = heads.agg(F.percentile_approx("_bucket", [i / m for i in range(m)]).alias("c")).first()["c"] or [0]
    h = heads.withColumn("_chunk", _position(F.col("_bucket"), sorted(set(cuts))))
    order = Window.orderBy("_chunk")
    firsts = h.groupBy("_chunk").agg(F.min("_bucket").alias("_first"))
    firsts = firsts.select("_chunk", F.coalesce(F.lead("_first").over(order), F.min("_first").over(
        Window.partitionBy(F.lit(1)))).alias("_next"))
    within = Window.partitionBy("_chunk").orderBy("_bucket")
    return h.join(F.broadcast(firsts), "_chunk").select(
        "_bucket", "_head", F.coalesce(F.lead("_bucket").over(within), F.col("_next")).alias("_to"))


def _position(c: Column, cuts: list[int]) -> Column:
    """Position of the last cut <= c (0 below all), searched in two steps of
    about sqrt(len) each."""
    if len(cuts) == 1:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    coarse = F.array(*[F.lit(x).cast("bigint") for x in cuts[::step]])
    rows = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in cuts[i:i + step]]) for i in range(0, len(cuts), step)])
    q = F.greatest(F.size(F.filter(coarse, lambda x: x <= c)) - 1, F.lit(0))
    return q * step + F.greatest(F.size(F.filter(F.get(rows, q), lambda x: x <= c)) - 1, F.lit(0))


def _bucketed(d: DataFrame, found: list[int], fine: int, n: int, n_null: int) -> DataFrame:
    """Adds ``_bucket``, which falls along the documents' order, and ``_h``, a
    hash of the text where rows of one id (or none) are told apart by it.

    An id that is found at several quantiles holds about the rows between
    them; its rows come after those between it and the next cut."""
    cuts, c = sorted(set(found)), F.col("doc_id")
    repeated = {x: found.count(x) * fine for x in cuts if n > BUCKET_ROWS and found.count(x) > 1}
    null_parts = -(-n_null // BUCKET_ROWS)
    d = d.withColumn("_q", _position(c, cuts))
    parts = F.when(c.isNull(), null_parts if null_parts > 1 else 0)
    if repeated:
        at = F.array(*[F.lit(repeated.get(x, 0)) for x in cuts])
        first = F.array(*[F.lit(x).cast("bigint") for x in cuts])
        parts = parts.when(c == F.get(first, "_q"), F.get(at, "_q"))
    d = d.withColumn("_parts", parts.otherwise(0))
    q = F.col("_q").cast("bigint")
    if fine > 1:
        flat = F.array(*[F.lit(x).cast("double") for x in cuts])
        lo = F.get(flat, "_q")
        width = F.greatest(F.lit(1.0), F.coalesce(F.get(flat, F.col("_q") + 1) - lo, F.lit(1.0)))
        q = q * fine + F.floor(F.greatest(F.lit(0.0), F.least(F.lit(0.999999), (c.cast("double") - lo) / width)) * fine)
    d = d.withColumn("_h", F.when(F.col("_parts") > 0, F.xxhash64("text")).otherwise(F.lit(0).cast("bigint")))
    part = F.least(F.col("_parts") - 1, F.floor((F.col("_h") / float(1 << 64) + 0.5) * F.col("_parts")))
    bucket = F.when(c.isNull(), F.lit(-1)).otherwise(q) * _PARTS \
        + F.when(F.col("_parts") > 0, _PARTS - 2 - part).otherwise(_PARTS - 1)
    return d.select("doc_id", "text", "_h", bucket.cast("bigint").alias("_bucket"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: fingerprint of its text and of its edited text (last third
    replaced by the start of the next document), hash of the edited text and
    the fingerprint of the next document."""
    k = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - k),
                      F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), k))
    rows = with_next(docs, id_col, text_col).withColumn("_e", edited).select(
        "_bucket", "_ghost", "_r", "doc_id", F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("_e"), 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("text").alias("t")),
                          F.struct(F.lit(1).alias("e"), F.col("_e").alias("t")))).alias("_v"))
    keys = ["_bucket", "_ghost", "_r", "doc_id", "n_chars", "edited_sha256"]
    rows = rows.filter(~F.col("_ghost") | (F.col("_v.e") == 0)).select(
        *keys, F.col("_v.e").alias("_edited"), terms(F.col("_v.t")).alias("_w"))
    fp = _votes(rows, [*keys, "_edited"], "_w")
    of = {x: F.max(F.when(F.col("_edited") == e, F.col(h))) for x, e, h in
          (("hi", 0, "hi"), ("lo", 0, "lo"), ("ehi", 1, "hi"), ("elo", 1, "lo"))}
    out = fp.groupBy(*keys).agg(*[c.alias(x) for x, c in of.items()])
    w = Window.partitionBy("_bucket").orderBy("_r")
    return out.withColumn("nhi", F.lead("hi").over(w)).withColumn("nlo", F.lead("lo").over(w)) \
        .filter(~F.col("_ghost")).drop("_bucket", "_ghost", "_r")


def op3_fingerprints(spark, sf_dir):
    d = cut(edited_pairs(read(spark, sf_dir, "documents")))
    # Search: the documents whose id is divisible by 50 against all rows.
    asked = F.coalesce(F.col("doc_id") % 50 == 0, F.lit(False))
    queries = d.filter(asked)
    near = within_radius(queries, d, RADIUS, BLOCKS).select("hi", "lo", "n_near", F.col("near").alias("near_fingerprints"))
    # Equal fingerprints are one query; its first document carries the list.
    near = near.join(queries.groupBy("hi", "lo").agg(F.min("doc_id").alias("_first")), ["hi", "lo"])
    found = queries.join(near, ["hi", "lo"], "left").withColumn(
        "near_fingerprints", F.when(F.col("doc_id") == F.col("_first"), F.col("near_fingerprints"))).drop("_first")
    out = found.unionByName(d.filter(~asked), allowMissingColumns=True)
    return out.select(
        "doc_id", "n_chars", "edited_sha256", printed("hi", "lo").alias("fingerprint"),
        printed("ehi", "elo").alias("edited_fingerprint"),
        likeness(hamming("hi", "lo", "ehi", "elo")).alias("near_edited"),
        likeness(hamming("hi", "lo", "nhi", "nlo")).alias("near_next"), "n_near", "near_fingerprints")
