"""Tail run logs as a stream of header records.

The file source picks up whole, closed files dropped (or rotated) into a
watched folder.  Only header lines are kept: a record's continuation lines
may land in another micro-batch, so they are left to the batch reader
(:func:`issuelens.sources.logs.read_run_logs`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.runs import PHASE_RE, RETRY_PREFIX
from ..sources.logs import FINAL_STATE_PREFIX, HEADER_RE, header_time


# Fixed value: the message of a run that ended well.
WORKFLOW_DONE = "Workflow completed successfully!"


def stream_run_log(spark: SparkSession, path: str, max_files_per_trigger: int | None = None, named: bool = False) -> DataFrame:
    """Streaming ``(source_path, ts, level, message, phase, is_retry,
    is_completion)`` of header lines; a header with an impossible date has a
    NULL ts.

    A file and a folder per run do not scale, so many runs may be collected in
    one file: if ``named``, each line is led by the name of its log and a tab,
    and that name is the ``source_path``; lines without a name are dropped."""
    r = spark.readStream.format("text").option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if named:
        tab = F.instr("value", "\t")
        lines = r.load(path).filter(tab > 0).select(F.substring_index("value", "\t", 1).alias("source_path"),
                                                    F.substr("value", tab + 1).alias("line"))
    else:
        lines = r.load(path).select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("line"))
    records = lines.filter(F.col("line").rlike(HEADER_RE)).select(
        "source_path", header_time(F.col("line")).alias("ts"),
        F.regexp_extract("line", r"^[^\[]*\[([A-Z]+)\] ", 1).alias("level"),
        F.regexp_replace("line", HEADER_RE, "").alias("message"))
    m = F.col("message")
    return records.select("*", F.nullif(F.regexp_extract(m, PHASE_RE, 1), F.lit("")).alias("phase"),
                          m.startswith(RETRY_PREFIX).alias("is_retry"),
                          (m.startswith(FINAL_STATE_PREFIX) | (m == WORKFLOW_DONE)).alias("is_completion"))


def run_to_parquet(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Exactly-once parquet sink (file sink + checkpoint)."""
    w = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
