"""Benchmark instances → run states → results and summaries.

Instances: ``pos, repo, instance_id, problem_statement, base_commit,
FAIL_TO_PASS, PASS_TO_PASS`` (the last two JSON-encoded string lists).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.json import STRICT, strict_json

# The code host prefix, the state literals given to every
# benchmark instance, and the skip reasons in the order they are checked.
HOST = "https://github.com/"
DESCRIPTION_PREFIX = "SWE-bench instance "
LANGUAGE = "Python"
DEPENDENCIES = ["pytest", "ruff", "black"]
REASON_NO_ID = "missing instance_id"
REASON_NO_REPO = "missing repo"
REASON_NO_FIELDS = "missing required fields"

def _empty() -> Column:
    return F.array().cast("array<string>")


def validate_instances(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(ok, rejected)``; the first failing rule is the ``reason``."""
    reason = (F.when(F.col("instance_id").isNull(), REASON_NO_ID)
              .when(F.col("repo").isNull(), REASON_NO_REPO)
              .when(F.col("problem_statement").isNull() | F.col("base_commit").isNull(), REASON_NO_FIELDS))
    tagged = df.withColumn("reason", reason)
    return tagged.filter(F.col("reason").isNull()).drop("reason"), tagged.filter(F.col("reason").isNotNull())


def clone_url(repo: Column) -> Column:
    """prepend the host unless the value starts with ``http``; append
    ``.git`` unless present."""
    return (F.when(repo.startswith("http"), repo)
            .when(repo.endswith(".git"), F.concat(F.lit(HOST), repo))
            .otherwise(F.concat(F.lit(HOST), repo, F.lit(".git"))))


def _truthy(df: DataFrame, col: str) -> Column:
    """Python truthiness of a scalar id column: NULL, the empty string and the
    number 0 are false, the text ``0`` is true."""
    empty = F.lit("") if isinstance(df.schema[col].dataType, T.StringType) else F.lit(0)
    return F.coalesce(F.col(col) != empty, F.lit(False))


def with_repo_urls(df: DataFrame, repo_col: str = "repo", id_col: str = "issue_id") -> DataFrame:
    """clone URL and issue URL (``N/A`` when the id is empty)."""
    url = clone_url(F.col(repo_col))
    path = F.replace(F.replace(url, F.lit(HOST), F.lit("")), F.lit(".git"), F.lit(""))
    issue = F.when(_truthy(df, id_col),
                   F.concat(F.lit(HOST), path, F.lit("/issues/"), F.col(id_col).cast("string"))).otherwise("N/A")
    return df.withColumn("clone_url", url).withColumn("issue_url", issue)


def test_ids(df: DataFrame) -> Column:
    """FAIL_TO_PASS then PASS_TO_PASS parsed as JSON string lists; bad
    JSON or a non-list contributes nothing; duplicates kept."""
    parse = lambda c: F.coalesce(F.from_json(strict_json(c), "array<string>", STRICT), _empty())
    return F.concat(parse("FAIL_TO_PASS"), parse("PASS_TO_PASS"))


def explode_tests(df: DataFrame) -> DataFrame:
    """one row per test id with its position in the combined list."""
    return df.select("pos", "instance_id", F.posexplode(test_ids(df)).alias("test_pos", "test_id"))


def instances_to_states(df: DataFrame) -> DataFrame:
    """the run state each instance starts from."""
    return df.select(
        "pos", "instance_id", "repo",
        clone_url(F.col("repo")).alias("repo_link"),
        F.concat(F.lit(DESCRIPTION_PREFIX), F.coalesce("instance_id", F.lit(""))).alias("project_description"),
        F.lit(LANGUAGE).alias("language"),
        F.array(*[F.lit(x) for x in DEPENDENCIES]).alias("dependencies"),
        F.coalesce("problem_statement", F.lit("")).alias("github_issue"),
        test_ids(df).alias("relevant_files"))


def first_instances(df: DataFrame, n: int = 3, order: str = "pos") -> DataFrame:
    """The first ``n`` instances by an explicit position column (file
    order is not defined in Spark).  The limit is the feature here."""
    return df.orderBy(order).limit(n)


def join_results(instances: DataFrame, runs: DataFrame) -> DataFrame:
    """One 6-column result per instance that has a run; instances
    without one yield no row."""
    return instances.select("repo", "instance_id").join(runs, "instance_id").select(
        "repo", "instance_id", F.col("passed").alias("tests_passed"), "code_changes", "test_results",
        "lint_results")


def collect_results(instances: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid instances joined with their runs, plus a quarantine table
    of skipped instances (reason) and instances with no run."""
    ok, rejected = validate_instances(instances)
    results = join_results(ok, runs)
    no_run = ok.join(runs.select("instance_id"), "instance_id", "left_anti") \
        .withColumn("reason", F.lit("no run result"))
    cols = ["pos", "instance_id", "repo", "reason"]
    return results, rejected.select(*cols).unionByName(no_run.select(*cols))


def write_results(results: DataFrame, path: str) -> None:
    """S8 sink: parquet partitioned by repository."""
    results.write.mode("overwrite").partitionBy("repo").parquet(path)


def benchmark_summary(results: DataFrame, key: str = "repo") -> DataFrame:
    """Per repository and overall (``repo`` = ``ALL``): instances,
    passed, success share, mean retries, mean duration.  One rollup
    aggregate (partial + final), no second pass."""
    agg = results.rollup(key).agg(
        F.count(F.lit(1)).alias("instances"),
        F.count_if(F.col("passed")).cast("bigint").alias("passed"),
        F.avg(F.col("retries").cast("double")).alias("mean_retries"),
        F.avg("duration_seconds").alias("mean_duration_seconds"),
        F.grouping(key).alias("_g"))
    return agg.select(
        F.when(F.col("_g") == 1, F.lit("ALL")).otherwise(F.col(key)).alias(key),
        "instances", "passed",
        F.round(F.col("passed") / F.col("instances"), 6).alias("success_share"),
        F.round("mean_retries", 6).alias("mean_retries"),
        F.round("mean_duration_seconds", 6).alias("mean_duration_seconds"))
