"""Repository files: reading a checkout (S3) and applying updates."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import py_rstrip
from ..operators.retrieval import repo_file_inventory
from ..operators.runs import _bucketed
from ..operators.textops import clean_response

_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?"


def read_repo_files(spark: SparkSession, root: str, repo: str | None = None,
                    with_content: bool = True) -> DataFrame:
    """S3: walk ``root`` recursively (``binaryFile`` source) and keep files
    with a source suffix; ``path`` is relative to ``root`` with ``/``.
    ``repo`` defaults to the last segment of ``root``.  Content is decoded
    as UTF-8 only when asked for (column pruning keeps it unread otherwise).
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    bare = re.sub(_SCHEME, "", root).strip("/")
    rel = F.regexp_extract(F.col("path"), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/]*)?/*" + re.escape(bare)
                           + r"/(.*)$", 1)
    cols = [F.lit(repo or bare.split("/")[-1]).alias("repo"), rel.alias("path")]
    if with_content:
        cols.append(F.decode("content", "UTF-8").alias("content"))
    return repo_file_inventory(df.select(*cols))


def apply_updates(snapshot: DataFrame, updates: DataFrame, order: str = "seq",
                  response_col: str = "response") -> DataFrame:
    """New content replaces old; an update whose cleaned text (F14) is
    empty is skipped; content is stored as ``rstrip(text) + "\\n"``; a file
    that does not exist is created; the last update of a file wins.
    Returns the new snapshot with ``status`` (created/updated/unchanged).
    Spark files are immutable, so the result is meant to be written as a new
    snapshot (:func:`write_snapshot`)."""
    u = (updates.withColumn("_new", clean_response(F.col(response_col))).filter(F.col("_new") != "")
         .groupBy("repo", "path").agg(F.max_by("_new", order).alias("_new")))
    u = u.withColumn("_new", F.concat(py_rstrip(F.col("_new")), F.lit("\n")))
    j = snapshot.select("repo", "path", F.col("content").alias("_old")).join(u, ["repo", "path"], "full_outer")
    status = (F.when(F.col("_new").isNull(), "unchanged").when(F.col("_old").isNull(), "created")
              .otherwise("updated"))
    return j.select("repo", "path", F.coalesce("_new", "_old").alias("content"), status.alias("status"))


def file_versions(snapshot: DataFrame, updates: DataFrame, requests: DataFrame, version: str = "version",
                  order: str = "seq", response_col: str = "response", rows: int = 20_000) -> DataFrame:
    """S9 over time: the content of files as of given versions.

    ``requests`` names ``(repo, path, version)``; each gets the update of that
    file with the largest version at or before it (of several of one version
    the last by ``order``; updates whose cleaned text is empty are skipped) and
    before the first update the content of ``snapshot`` (NULL if it has no such
    file).  Returns ``(repo, path, version, content_version, content)``, one
    row per distinct request.

    An as-of join by a union: requests and updates of a file are sorted
    together and the last update is carried forward, inside parts of the file's
    rows (:func:`..operators.runs.run_cuts`) and, over the parts, from their
    last updates, so that one file with most of the updates is many tasks.
    """
    u = (updates.withColumn("_new", clean_response(F.col(response_col)))
         .filter((F.col("_new") != "") & F.col(version).isNotNull())
         .groupBy("repo", "path", F.col(version).alias("version")).agg(F.max_by("_new", order).alias("_new")))
    u = u.select("repo", "path", "version", F.lit(0).alias("_kind"), F.concat(py_rstrip(F.col("_new")), F.lit("\n")).alias("_new"))
    asked = requests.select("repo", "path", F.col(version).alias("version")).distinct() \
        .select("*", F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_new"))
    both = u.unionByName(asked).withColumn("_file", F.struct("repo", "path"))
    x = _bucketed(both, "_file", ("version", "_kind"), rows)
    update = F.when(F.col("_kind") == 0, F.struct("version", "_new"))
    w = Window.partitionBy("_file", "_b").orderBy("version", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_within", F.last(update, ignorenulls=True).over(w))
    earlier = Window.partitionBy("_f").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = x.groupBy(F.col("_file").alias("_f"), F.col("_b").alias("_part")).agg(F.max_by(update, F.when(F.col("_kind") == 0, F.col("version"))).alias("_last")) \
        .select("_f", "_part", F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))
    base = snapshot.select("repo", "path", F.col("content").alias("_base"))
    found = x.filter("_kind = 1").join(carried, F.col("_file").eqNullSafe(F.col("_f")) & (F.col("_b") == F.col("_part"))) \
        .withColumn("_got", F.coalesce("_within", "_carry"))
    return found.join(base, ["repo", "path"], "left").select(
        "repo", "path", "version", F.col("_got.version").alias("content_version"),
        F.coalesce("_got._new", "_base").alias("content"))


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    """Write a snapshot partitioned by repository."""
    snapshot.write.mode("overwrite").partitionBy("repo").parquet(path)
