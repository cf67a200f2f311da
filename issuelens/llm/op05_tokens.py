"""Training-order output of token ids as fixed-stride binary shards.

A document's token ids and an end token are cut into sequences of ``length``
ids (the last one padded).  A keyed Feistel permutation with cycle-walking
over the key space (id, sequence of the id) gives every sequence its slot in
the training order without any sort of the whole or a count of tokens.  Equal
ranges of slots are the shards: one shuffle takes each range to a task of its
own, which writes it in slot order by Spark's own writer (so a lost task is
simply written again).  Record i of a shard starts at byte ``i * stride``:

    slot int64 | doc_id int64 | sequence int32 | n_tokens int32 | length x uint16 | "\\n"

all little endian (padding holds the end token; sequence k of a row without an
id is written as -1 - k and its doc_id as 0).  A reader that knows the number
of records it has read resumes by seeking (``resume``).

Cases: a null or empty text is a sequence with the end token only; a row
without an id takes a key by a hash of its text, which a document may have as
well, and reads back without an id; rows that share a key share slots and follow
each other by a checksum of the record; ids whose range times the sequences per document
is 2^62 or more are refused (ValueError) before anything is written; an empty
table gives an empty folder; further columns are ignored.
"""

from __future__ import annotations

import base64
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, scratch

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50_256
HEADER = "<qqii"
HEAD_BYTES = struct.calcsize(HEADER)
ROUNDS = 4
MAX_KEYS = 1 << 62


def stride(length: int) -> int:
    return HEAD_BYTES + 2 * length + 1


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def feistel(x: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed permutation of 0 .. size-1: four Feistel rounds on the next even
    number of bits, again and again (cycle-walking) until inside."""
    half = max(1, ((max(size, 2) - 1).bit_length() + 1) // 2)
    if half > 31:
        raise ValueError("the key space has more than 2^62 keys")  # as MAX_KEYS
    low, h = np.uint64((1 << half) - 1), np.uint64(half)
    out = x.astype(np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        a, b = out[todo] >> h, out[todo] & low
        for r in range(ROUNDS):
            a, b = b, a ^ (_mix(b, key * ROUNDS + r) & low)
        out[todo] = (a << h) | b
        todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)


def unfeistel(y: np.ndarray, size: int, key: int) -> np.ndarray:
    """The inverse of :func:`feistel`."""
    half = max(1, ((max(size, 2) - 1).bit_length() + 1) // 2)
    low, h = np.uint64((1 << half) - 1), np.uint64(half)
    out = y.astype(np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        a, b = out[todo] >> h, out[todo] & low
        for r in reversed(range(ROUNDS)):
            a, b = b ^ (_mix(a, key * ROUNDS + r) & low), a
        out[todo] = (a << h) | b
        todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)


@lru_cache(maxsize=2)
def _encoder(vocabulary: bytes):
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sequences(docs: DataFrame, vocabulary: bytes, keys: dict, length: int, seed: int, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """(slot, record): the sequences of every document as printed records."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        enc, n_keys = _encoder(shared.value), keys["size"] // keys["per_id"]
        for b in batches:
            for at in range(0, b.num_rows, 200):
                ids, texts = b.column(0).slice(at, 200).to_pylist(), b.column(1).slice(at, 200).to_pylist()
                head, body = [], []
                for i, t in zip(ids, texts):
                    tok = np.asarray([*enc.encode_ordinary(t or ""), END], np.uint16)
                    n = -(-len(tok) // length)
                    full = np.full(n * length, END, np.uint16)
                    full[:len(tok)] = tok
                    body.append(full.tobytes())
                    # Rows without an id are many at most: their texts spread them.
                    key = xxhash.xxh64_intdigest((t or "").encode()) % n_keys if i is None else i - keys["first"] + 1
                    head.extend((key * keys["per_id"] + k, i or 0, -1 - k if i is None else k, min(length, len(tok) - k * length))
                                for k in range(n))
                slots = feistel(np.array([h[0] for h in head], np.int64), keys["size"], seed)
                raw = b"".join(body)
                records = [struct.pack(HEADER, s, h[1], h[2], h[3]) + raw[2 * length * j:2 * length * (j + 1)]
                           for j, (s, h) in enumerate(zip(slots.tolist(), head))]
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(records, pa.binary())], ["slot", "record"])
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "slot bigint, record binary")


def write_shards(docs: DataFrame, path: str, vocabulary_path: str = VOCABULARY, length: int = 512, seed: int = 20_24,
                 shard_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Write the shards (folders ``shard=N``) and return the layout."""
    size = docs.agg(F.min(id_col).alias("a"), F.max(id_col).alias("b"), F.max(F.octet_length(text_col)).alias("m"),
                    F.sum(F.octet_length(text_col)).alias("n")).first()
    first, last = size["a"] or 0, size["b"] or 0
    # Each token covers a byte or more: no document has more sequences.
    per_id = -(-((size["m"] or 0) + 1) // length)
    keys = {"first": first, "per_id": per_id, "size": (last - first + 2) * per_id}
    if keys["size"] > MAX_KEYS:
        raise ValueError(f"ids from {first} to {last} with {per_id} sequences each: more than 2^62 keys")
    shards = max(1, -(-(size["n"] or 0) // shard_bytes))
    with open(vocabulary_path, "rb") as f:  # on the driver; the tasks get it by broadcast (under 1 MB)
        vocabulary = f.read()
    rows = sequences(docs, vocabulary, keys, length, seed, id_col, text_col)
    width = -(-keys["size"] // shards)
    rows.select(F.expr(f"slot div {width}").cast("int").alias("shard"), "slot", F.crc32("record").alias("crc"),
                F.col("record").cast("string").alias("value")).repartitionById(shards, F.col("shard")) \
        .sortWithinPartitions("shard", "slot", "crc", "value").select("shard", "value") \
        .write.partitionBy("shard").text(path)
    return {"path": path, "length": length, "stride": stride(length), "shards": shards, "width": width, "seed": seed, **keys}


def header(record: bytes) -> tuple:
    """(slot, doc_id, sequence, n_tokens) of a record."""
    slot, doc, k, m = struct.unpack_from(HEADER, record)
    return (slot, None, -1 - k, m) if k < 0 else (slot, doc, k, m)


def resume(file, layout: dict, records: int):
    """The records of an open shard file from number ``records`` on, as
    (slot, doc_id, sequence, n_tokens, ids)."""
    file.seek(records * layout["stride"])
    while record := file.read(layout["stride"]):
        slot, doc, k, m = header(record)
        yield slot, doc, k, m, np.frombuffer(record, np.uint16, m, HEAD_BYTES)


def read_shards(spark: SparkSession, layout: dict) -> DataFrame:
    """The records as written: (shard, record, position, slot, doc_id, seq,
    n_tokens, tokens).  ``position`` counts over all shards."""
    n, step = layout["length"], layout["stride"]
    width = layout["width"]

    def parse(records):
        for r in records:
            slot, doc, k, m = header(r)
            yield slot // width, slot, doc, k, m, bytearray(r[HEAD_BYTES:HEAD_BYTES + 2 * n]), zlib.crc32(r[:-1])
    rdd = spark.sparkContext.binaryRecords(f"{layout['path']}/shard=*", step).mapPartitions(parse)
    rows = spark.createDataFrame(rdd, "shard int, slot bigint, doc_id bigint, seq int, n_tokens int, tokens binary, _crc bigint")
    return with_positions(rows)


def with_positions(rows: DataFrame) -> DataFrame:
    """Adds the record number in the shard and the position in the whole;
    records of one slot are written in the order of their checksums."""
    w = Window.partitionBy("shard").orderBy("slot", "_crc")
    base = rows.groupBy("shard").agg(F.count("*").alias("_n")).withColumn(
        "_base", F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).select(F.col("shard").alias("_s"), "_base")
    return rows.withColumn("record", F.row_number().over(w) - 1).join(base, F.col("shard") == F.col("_s")) \
        .withColumn("position", (F.col("_base") + F.col("record")).cast("bigint")).drop("_s", "_base", "_crc")


def read_digests(spark: SparkSession, layout: dict) -> DataFrame:
    """As :func:`read_shards` with a checksum of the valid ids in their place."""
    width = layout["width"]

    def parse(records):
        for r in records:
            slot, doc, k, m = header(r)
            yield slot // width, slot, doc, k, m, zlib.crc32(r[HEAD_BYTES:HEAD_BYTES + 2 * m]), zlib.crc32(r[:-1])
    rdd = spark.sparkContext.binaryRecords(f"{layout['path']}/shard=*", layout["stride"]).mapPartitions(parse)
    return with_positions(spark.createDataFrame(
        rdd, "shard int, slot bigint, doc_id bigint, seq int, n_tokens int, tokens_crc bigint, _crc bigint"))


def op5_token_shards(spark, sf_dir):
    layout = write_shards(read(spark, sf_dir, "documents"), scratch(spark, "tokens"))
    return read_digests(spark, layout)
