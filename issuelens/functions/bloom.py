"""Bloom filters as small tables: bounded in size whatever they are made of.

A filter of ``bits`` bits (one hash) is a table of buckets of 4 KB, made by a
partial and a final aggregate and joined by broadcast.  It lets every row
through whose key was put in, and about ``keys / bits`` of the others.  A
bucket is broadcast as 512 numbers: a test reads one of them, where bytes would
be copied as a whole for every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _place(cols, bits: int):
    return F.pmod(F.xxhash64(*cols), F.lit(bits))


def bloom_filter(keys: DataFrame, cols, bits: int) -> DataFrame:
    """(``_bucket``, ``_bits``) of the key columns of all rows."""
    return keys.select(_place(cols, bits).alias("_h")).groupBy(F.bitmap_bucket_number("_h").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_h")).alias("_bits"))


def may_hold(rows: DataFrame, filter_: DataFrame, cols, bits: int) -> DataFrame:
    """The rows whose key may be in the filter, with their columns."""
    h = _place(cols, bits)
    at = F.bitmap_bit_position(h)
    numbers = filter_.select("_bucket", F.expr(
        "transform(sequence(0, 511), i -> cast(conv(hex(substring(_bits, 8 * i + 1, 8)), 16, -10) AS bigint))").alias("_bits"))
    # Bytes go from the highest of a number to its lowest, the bits of a byte the other way.
    hit = F.getbit(F.get("_bits", F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).bitwiseXOR(F.lit(56)).cast("int")) == 1
    return rows.withColumn("_bucket", F.bitmap_bucket_number(h)).join(F.broadcast(numbers), "_bucket").filter(hit).select(*rows.columns)
