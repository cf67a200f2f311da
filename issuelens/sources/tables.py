"""Readers for the driver's parquet tables and the views derived from them.

The driver's tables are generic (TPC-H-like plus text tables).  The views
below give them the shape of this library's tables (issues, repository
files, attempts, checks, recorded calls) with plain column expressions, so
every operator runs over data whose size grows with the inputs.  The same
definitions exist as SQL in :mod:`issuelens.oracle` for the DuckDB check.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

NL = "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, task_mb: float = 2.0, total_mb: float = 256.0) -> DataFrame:
    """Deals the rows of a scan whose tasks would read more than ``task_mb`` of
    file to more tasks: a file of one row group is one task otherwise, however
    dear the work per byte is.  The split is planned from the file sizes, not
    from the session's cores.  Inputs above ``total_mb`` have row groups enough
    and are left as they are, without a shuffle.  Filters and column pruning
    still reach the scan."""
    mb = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) / (1 << 20)
    tasks = math.ceil(mb / task_mb)
    if mb > total_mb or tasks < 2 or df.rdd.getNumPartitions() >= tasks:
        return df
    return df.repartition(tasks)


def _repo_of(key) -> "F.Column":
    return F.concat(F.lit("org"), (key % 5).cast("string"), F.lit("/repo"), (key % 25).cast("string"))


def v_repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part: a file of one of 25 repositories (paths repeat)."""
    k = F.col("p_partkey")
    nm = F.regexp_replace("p_name", " ", "_")
    path = (F.when(k % 4 == 0, F.concat(F.lit("src/"), nm, F.lit(".py")))
            .when(k % 4 == 1, F.concat(F.lit("tests/test_"), nm, F.lit(".py")))
            .when(k % 4 == 2, F.concat(F.lit("web/"), nm, F.lit(".tsx")))
            .otherwise(F.concat(F.lit("docs/"), nm, F.lit(".md"))))
    content = F.concat(F.lit("# "), F.col("p_type"), F.lit(NL), F.lit("size = "),
                       F.col("p_size").cast("string"), F.lit(NL))
    return table(spark, sf_dir, "part").select(
        _repo_of(k).alias("repo"), k.alias("file_id"), path.alias("path"), content.alias("content"))


def v_repo_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ``pyproject.toml`` per repository; one repo in three enables doctest-rst."""
    k = F.col("p_partkey")
    body = F.when((k % 25) % 3 == 0,
                  F.lit('[tool.pytest.ini_options]\naddopts = "--doctest-rst"\n')
                  ).otherwise(F.lit('[project]\nname = "x"\n'))
    return (table(spark, sf_dir, "part")
            .select(_repo_of(k).alias("repo"), F.lit("pyproject.toml").alias("path"), body.alias("content"))
            .distinct())


CODE_SAMPLE = "```python\n# a comment\nf(**a, **b)  \nx = '<div>'\n\n\ny = __name__\n```"


def v_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One issue per document.  Of ten, one names no file, one names several
    (some twice, with code around), one a stem that is in every test file's
    name; the others name one file of a part."""
    d = spread(table(spark, sf_dir, "documents")).alias("d")
    p = table(spark, sf_dir, "part").alias("p")
    doc = F.col("d.doc_id")
    name = F.coalesce(F.regexp_replace("p.p_name", " ", "_"), F.lit("unnamed"))
    ext = F.when(doc % 3 == 0, ".py").when(doc % 3 == 1, ".tsx").otherwise(".json")
    several = F.concat(F.lit("`"), name, ext, F.lit("`, `src/"), name, F.lit(".py` and again `"), name, ext,
                       F.lit("`; see `__init__.py` and <b>below</b>" + NL + CODE_SAMPLE))
    named = (F.when(doc % 10 == 3, F.lit("no file named"))
             .when(doc % 10 == 5, several).when(doc % 10 == 7, F.lit("`test.py`"))
             .otherwise(F.concat(F.lit("`"), name, ext, F.lit("`"))))
    body = F.concat(F.lit("### Fix" + NL + NL + "**File:** "), named, F.lit(NL), F.col("d.text"))
    return d.join(p, F.col("p.p_partkey") == doc, "left").select(
        doc.alias("issue_id"), _repo_of(doc).alias("repo"), doc.alias("number"), body.alias("body"),
        F.when(doc % 7 == 0, "closed").otherwise("open").alias("state"))


def v_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    tp = F.when((F.col("event_type") == "signup") & (F.col("event_id") % 5 == 0), F.lit(None).cast("boolean")) \
        .otherwise(F.col("event_type") == "purchase")
    errs = F.when(F.col("event_type") != "purchase", F.concat(F.lit("err "), F.col("event_id").cast("string")))
    return e.select(F.col("user_id").alias("run_id"), (F.col("user_id") % 10).alias("agent_id"),
                    "event_id", "ts", tp.alias("tests_passed"), errs.alias("errors"))


def v_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One check (test or lint run of one file) per line item.

    ``seq`` orders the checks of a run; (order, line number) alone is not
    unique in the table, so further columns break ties.
    """
    li = table(spark, sf_dir, "lineitem")
    ln = F.col("l_linenumber")
    file = F.concat(F.lit("f"), ln.cast("string"), F.when(ln % 2 == 0, ".py").otherwise("_test.py"))
    exit_code = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    stdout = F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 45), "no tests ran in 0.01s") \
        .otherwise("1 passed in 0.1s")
    stderr = F.when(F.col("l_returnflag") == "R",
                    F.concat(F.lit("AssertionError: line "), ln.cast("string"))).otherwise("")
    error = F.when(F.col("l_quantity") == 1, F.concat(F.lit("timeout after "), ln.cast("string"), F.lit("s")))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                                                 "l_extendedprice")
    return li.select(
        F.col("l_orderkey").alias("run_id"), F.row_number().over(w).cast("bigint").alias("seq"),
        F.when(ln % 2 == 0, "lint").otherwise("test").alias("kind"), file.alias("file"),
        exit_code.alias("exit_code"), stdout.alias("stdout"), stderr.alias("stderr"), error.alias("error"))


def v_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded model calls: a user turn and the assistant turn after it."""
    c = table(spark, sf_dir, "conversations")
    u = c.filter(F.col("role") == "user").alias("u")
    a = c.filter(F.col("role") == "assistant").alias("a")
    return u.join(a, (F.col("u.conv_id") == F.col("a.conv_id")) & (F.col("a.turn") == F.col("u.turn") + 1)) \
        .select((F.col("u.conv_id") * 1000 + F.col("u.turn")).alias("call_id"),
                F.col("u.conv_id").alias("conv_id"), F.col("u.turn").alias("turn"),
                F.col("u.text").alias("prompt"), F.col("a.text").alias("response"))


def _event_level():
    et = F.col("event_type")
    return F.when(et == "error", "ERROR").when(et == "click", "WARNING").otherwise("INFO")


def _event_message():
    et = F.col("event_type")
    return (F.when(et == "signup", F.lit("=== starting test_and_lint phase ==="))
            .when(et == "view", F.lit("agent_respond() asked for a plan"))
            .when(et == "purchase", F.lit("Workflow completed successfully!"))
            .when(et == "click", F.lit("Tests did not pass. Retrying once more"))
            .otherwise(F.concat(F.lit("check failed for f"), (F.col("event_id") % 7).cast("string"),
                                F.lit(".py:\nSTDOUT:\n"), F.col("props"))))


def v_log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log record per event: run = user, level and message by type."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("run_"), F.col("user_id").cast("string"), F.lit(".log")).alias("source_file"),
                    F.col("user_id").alias("run_id"), "event_id", "ts",
                    _event_level().alias("level"), _event_message().alias("message"))


def v_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of :func:`v_log_records` printed as log text lines,
    numbered from 1 in the order of the events.  Of the runs, one in nine
    starts with two lines before any header, and one record in 97 has an
    impossible date."""
    r = v_log_records(spark, sf_dir)
    stamp = F.when(F.col("event_id") % 97 == 5, F.lit("2024-13-45 10:00:00,000")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"))
    text = F.concat(stamp, F.lit(" ["), F.col("level"), F.lit("] "), F.col("message"))
    of_run = Window.partitionBy("run_id").orderBy("event_id")
    headless = (F.col("run_id") % 9 == 0) & (F.row_number().over(of_run) == 1)
    text = F.when(headless, F.concat(F.lit("Loading settings" + NL + "done" + NL), text)).otherwise(text)
    r = r.select("source_file", "run_id", "event_id", F.split(text, "\n").alias("lines"))
    before = F.coalesce(F.sum(F.size("lines")).over(of_run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return r.withColumn("before", before).select("source_file", "before", F.posexplode("lines").alias("pos", "line")) \
        .select("source_file", (F.col("before") + F.col("pos") + 1).cast("bigint").alias("line_no"), "line")


def v_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark instances from ``benchmark``: test-id lists as JSON text
    built from the line items of the order with the same key; some fields
    missing, some lists malformed."""
    b = table(spark, sf_dir, "benchmark")
    li = table(spark, sf_dir, "lineitem")
    tid = F.concat(F.lit("tests/test_f"), F.col("l_linenumber").cast("string"), F.lit(".py::test_"),
                   F.col("l_partkey").cast("string"))
    lists = li.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.when(F.col("l_returnflag") == "R", tid))).alias("f2p"),
        F.sort_array(F.collect_list(F.when(F.col("l_returnflag") != "R", tid))).alias("p2p"))
    i = F.col("item_id")
    short = F.concat(F.lit("org"), (i % 5).cast("string"), F.lit("/repo"), (i % 25).cast("string"))
    repo = (F.when(i % 13 == 0, F.lit(None).cast("string"))
            .when(i % 3 == 1, F.concat(F.lit("https://github.com/"), short))
            .when(i % 3 == 2, F.concat(short, F.lit(".git"))).otherwise(short))
    f2p = (F.when(i % 7 == 3, F.lit("[broken")).when(i % 7 == 5, F.lit('"tests/x.py"'))
           .otherwise(F.to_json(F.coalesce("f2p", F.array().cast("array<string>")))))
    return b.join(lists, F.col("l_orderkey") == i, "left").select(
        i.alias("pos"),
        F.when(i % 11 != 0, F.concat(F.lit("inst-"), i.cast("string"))).alias("instance_id"),
        repo.alias("repo"),
        F.when(i % 17 != 0, F.col("text")).alias("problem_statement"),
        F.when(i % 19 != 0, F.substring(F.sha2("text", 256), 1, 12)).alias("base_commit"),
        f2p.alias("FAIL_TO_PASS"),
        F.to_json(F.coalesce("p2p", F.array().cast("array<string>"))).alias("PASS_TO_PASS"))
