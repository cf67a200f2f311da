"""Corpus pipeline: language ID, near-duplicate removal, redaction of personal
data, mixing to target weights, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, with the columns of ``documents`` in all but the last.
``run`` writes each stage's result as Parquet in the shared folder and reads
it again as the next stage's input.

Every stage handles null ids, texts and sources, empty tables and repeated
rows as its operator defines; columns beyond those of ``documents`` pass
through the stages but the last.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from issuelens.llm import op01_packing, op04_mixing, op07_pii, op08_minhash, op09_language
from issuelens.llm.common import cut, held, read, scratch, text_of, words


def with_row(docs: DataFrame) -> DataFrame:
    """Adds ``_il_row``, a key of the row itself that every scan gives again:
    its file and place there, or (input that is no file) a persisted number."""
    try:
        return docs.withColumn("_il_row", F.xxhash64("_metadata.file_path", "_metadata.row_index"))
    except AnalysisException:
        return cut(docs.withColumn("_il_row", F.monotonically_increasing_id()))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a main language: no letters, no language with two
    fifths of the letters, more letters in scripts of no learned language, or
    letter noise."""
    model = op09_language.fit(docs.filter(held("doc_id", 5) != 0))
    names = ("_il_lang", "_il_score", "_il_spans", "_il_share", "_il_clear")
    found = op09_language.identify(docs, model, names=names)
    return found.filter((F.col(names[0]) != op09_language.UND) & (F.col(names[3]) >= 0.4) & F.col(names[4])) \
        .select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group (words in fives, similarity
    0.8), the one with the smallest id; rows are told apart by a key of their
    own, so repeated rows and rows without an id are linked as well."""
    keyed = with_row(docs)
    found = op08_minhash.near_duplicates(keyed, id_col="_il_row", k=5, percent=80)
    ids = keyed.select("_il_row", F.col("doc_id").alias("_il_id"))
    stay = found.select(F.col("doc_id").alias("_il_row"), F.col("component_id").alias("_il_group")).join(ids, "_il_row") \
        .groupBy("_il_group").agg(F.min(F.struct(F.isnull("_il_id"), "_il_id", "_il_row")).alias("_il_first")) \
        .select("_il_first._il_row")
    return keyed.join(stay, "_il_row", "left_semi").select(*docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by ``[KIND]``; all documents stay."""
    return op07_pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the sources meet their targets.
    Every row is rounded on its own.  Equal rows (id, text and source) are
    numbered from 0, in 64 parts by a hash of the row, so that the keys and
    with them the random numbers are the same in every run."""
    keyed = with_row(docs)
    small = cut(keyed.select(
        "_il_row", F.col("source").cast("string").alias("source"), F.xxhash64("doc_id", text_of(), "source").alias("_c"),
        F.size(words(text_of())).cast("bigint").alias("size"), F.pmod(F.xxhash64("_il_row"), F.lit(64)).alias("_part")))
    before = Window.partitionBy("_c").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = small.groupBy("_c", "_part").agg(F.count("*").alias("_n")).select(
        "_c", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_c", "_part").orderBy("_il_row"))
    sizes = cut(small.withColumn("_place", place).join(parts, ["_c", "_part"]).select(
        "_il_row", "source", "size", F.xxhash64("_c", F.col("_before") + F.col("_place")).alias("doc_id")))
    targets = cut(op04_mixing.source_targets(sizes.select("source", "size")))
    copies = op04_mixing.round_copies(sizes.select("doc_id", "source", "size"), targets).filter("copies > 0") \
        .select("doc_id", F.col("copies").alias("_il_n"))
    taken = sizes.select("_il_row", "doc_id").join(copies, "doc_id").select("_il_row", "_il_n")
    return keyed.join(taken, "_il_row").withColumn("_il_copy", F.explode(F.sequence(F.lit(1), F.col("_il_n")))) \
        .select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2048 words: one row per piece of a document."""
    return op01_packing.pack(docs, op01_packing.text_cluster(text_of()))


STAGES = [("language ID", language), ("MinHash near-dedup", near_dedup), ("PII", redact_pii),
          ("mixing sources", mix_sources), ("best-fit packing", pack)]

#: Viterbi labels, MinHash and random rounding have no SQL form; the stages
#: are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name.replace(" ", "_"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
