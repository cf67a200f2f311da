"""Run-log source (S5), final-state extraction (S6) and state report.

Log format: ``YYYY-mm-dd HH:MM:SS,mmm [LEVEL] message``; a line without
that header continues the record before it.

Grouping lines into records needs "the last header at or before this
line".  Doing that with one window over a whole file would put the file in
one task, so it is done in two levels: lines are bucketed by line number
(``bucket`` lines each), a window inside each (file, bucket) finds the last
header so far, and a window over the much smaller per-bucket summary
carries the last header of earlier buckets forward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.json import STRICT, strict_json

# The header of a log record and the prefix of the final
# state message.
HEADER_RE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3} \[[A-Z]+\] "
FINAL_STATE_PREFIX = "Final General Coding Project State:"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as ``(source_file, line_no, line)`` with exact 1-based
    line numbers, computed without reading any file in one task: each split
    numbers its lines, a prefix sum over the splits of a file gives offsets.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_blk"),
        F.monotonically_increasing_id().alias("_mid"),
        F.col("value").alias("line"))
    # The generated id only orders the lines of a split, in this one branch.
    raw = raw.withColumn("_i", F.row_number().over(Window.partitionBy("source_file", "_blk").orderBy("_mid"))).drop("_mid")
    blocks = raw.groupBy("source_file", "_blk").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("source_file").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return (raw.join(blocks, ["source_file", "_blk"])
            .select("source_file", (F.col("_off") + F.col("_i")).alias("line_no"), "line"))


def header_time(text: Column) -> Column:
    """The time of a header line; NULL where it is no date."""
    return F.replace(F.substring(text, 1, 23), F.lit(","), F.lit(".")).try_cast("timestamp_ntz")


def parse_log_lines(lines: DataFrame, bucket: int = 4096, file_col: str = "source_file",
                    line_no_col: str = "line_no", line_col: str = "line") -> DataFrame:
    """Lines → records ``(source_file, line_no, ts, level, message)``.

    ``line_no`` of a record is that of its header; each line before the
    first header of a file is a record with NULL ts/level; a header with an
    impossible date keeps its text and has a NULL ts.  Line numbers only need
    to be increasing within a file (gaps are fine).
    """
    ln = F.col(line_no_col)
    hdr = F.when(F.col(line_col).rlike(HEADER_RE), ln)
    b = F.floor(ln / bucket)
    x = lines.select(F.col(file_col).alias("source_file"), ln.alias("line_no"), F.col(line_col).alias("line"),
                     b.alias("_b"), hdr.alias("_hdr"))
    w_in = Window.partitionBy("source_file", "_b").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_within", F.max("_hdr").over(w_in))
    summary = x.groupBy("source_file", "_b").agg(F.max("_hdr").alias("_last"))
    w_b = Window.partitionBy("source_file").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select("source_file", "_b", F.max("_last").over(w_b).alias("_carry"))
    x = x.join(summary, ["source_file", "_b"]).withColumn(
        "_rec", F.coalesce("_within", "_carry"))
    # Before the first header every line is a record of its own.
    x = x.withColumn("_own", F.when(F.col("_rec").isNull(), F.col("line_no")))
    rec = x.groupBy("source_file", "_rec", "_own").agg(
        F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("_lines"))
    text = F.array_join(F.transform("_lines", lambda s: s["line"]), "\n")
    is_rec = F.col("_rec").isNotNull()
    return rec.select(
        "source_file",
        F.coalesce("_rec", "_own").alias("line_no"),
        F.when(is_rec, header_time(text)).alias("ts"),
        F.when(is_rec, F.regexp_extract(text, r"^[^\[]*\[([A-Z]+)\] ", 1)).alias("level"),
        F.when(is_rec, F.regexp_replace(text, HEADER_RE, "")).otherwise(text).alias("message"))


def read_run_logs(spark: SparkSession, path: str, bucket: int = 4096) -> DataFrame:
    """S5 over files: read lines with exact numbers, then group records."""
    return parse_log_lines(read_lines(spark, path), bucket)


# The state printed at the end of a run (modular variant).
STATE_SCHEMA = T.StructType([
    T.StructField("github_issue", T.StringType()),
    T.StructField("project_context", T.StringType()),
    T.StructField("plan", T.StructType([
        T.StructField("relevant_files", T.ArrayType(T.StringType())),
        T.StructField("source_files", T.ArrayType(T.StringType())),
        T.StructField("test_files", T.ArrayType(T.StringType())),
        T.StructField("is_test_generation_issue", T.BooleanType())])),
    T.StructField("code_changes", T.StructType([
        T.StructField("updated_files", T.ArrayType(T.StringType())),
        T.StructField("commit_message", T.StringType())])),
    T.StructField("test_results", T.StructType([
        T.StructField("test_outputs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("tests_passed", T.BooleanType())])),
    T.StructField("lint_results", T.StructType([
        T.StructField("lint_outputs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("lint_passed", T.BooleanType())])),
    T.StructField("passed", T.BooleanType()),
    T.StructField("last_errors", T.StringType()),
])


def final_states(records: DataFrame, message_col: str = "message") -> DataFrame:
    """Parse the state printed after ``Final General Coding Project
    State:``.  Missing keys are NULL, unknown keys ignored; a state that is
    not exactly one JSON value (the Python-literal form, text after it) gives a NULL ``state`` and keeps the
    raw text in ``corrupt_state``."""
    schema = T.StructType(STATE_SCHEMA.fields + [T.StructField("_corrupt", T.StringType())])
    body = F.regexp_replace(F.col(message_col), r"^Final General Coding Project State:\s*", "")
    parsed = F.from_json(strict_json("_body"), schema, {**STRICT, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = (records.filter(F.col(message_col).startswith(FINAL_STATE_PREFIX))
           .withColumn("_body", body).withColumn("_p", parsed))
    bad = F.col("_p").isNull() | F.col("_p._corrupt").isNotNull()
    return out.select(*[c for c in records.columns if c != message_col],
                      F.when(~bad, F.col("_p").dropFields("_corrupt")).alias("state"),
                      F.when(bad, F.col("_body")).alias("corrupt_state"))


def state_json(runs: DataFrame, cols=None, pretty: bool = False) -> "F.Column":
    """One JSON object per row; nulls printed (not dropped)."""
    cols = cols or runs.columns
    opts = {"ignoreNullFields": "false"}
    if pretty:
        opts["pretty"] = "true"
    return F.to_json(F.struct(*cols), opts)


def write_state_report(runs: DataFrame, path: str, cols=None) -> None:
    """One pretty JSON object per run (Spark's own layout, ``"key" :
    value``), nulls printed, non-ASCII kept, every column of the state."""
    runs.select(state_json(runs, cols, pretty=True).alias("value")).write.mode("overwrite").text(path)
