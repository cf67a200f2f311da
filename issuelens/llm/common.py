"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.  Only
    a local session (tests) gets a folder of its own when it is unset."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="issuelens-shared-")
        atexit.register(shutil.rmtree, d, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/issuelens-llm/{name}-{uuid.uuid4().hex[:12]}"


def with_place(docs: DataFrame, *cols: Column) -> DataFrame:
    """The columns ``cols`` of every row and ``_place``, a number from 1 among
    the rows where they are equal; so rows without an id and repeated rows can
    be dealt apart by a hash, alike in every run.  Rows are numbered in 64
    parts by a key of the row itself: its file and place there, or (input that
    is no file) a persisted number."""
    try:
        rows = docs.select(*cols, F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("_row"))
    except AnalysisException:
        rows = cut(docs.select(*cols, F.monotonically_increasing_id().alias("_row")))
    names = rows.columns[:-1]
    rows = cut(rows.select(*names, F.xxhash64(*names).alias("_c"), F.pmod(F.xxhash64("_row"), F.lit(64)).alias("_part"), "_row"))
    before = Window.partitionBy("_c").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_c", "_part").agg(F.count("*").alias("_n_part")).select(
        "_c", "_part", F.coalesce(F.sum("_n_part").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_c", "_part").orderBy("_row"))
    return rows.withColumn("_at", place).join(parts, ["_c", "_part"]).select(
        *names, (F.col("_before") + F.col("_at")).alias("_place"))


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a non-null text, in order."""
    body = F.btrim(text, F.lit(SPACE))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE_RE))


def held(col: str, modulus: int) -> Column:
    """crc32 of the id's text modulo ``modulus`` (a null id: -1)."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % modulus, F.lit(-1).cast("bigint"))
