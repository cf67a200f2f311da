"""Prompt datasets, recorded-response replay and pluggable responders.

Prompts are built with ``concat``/``array_join`` over columns (template
text is our own wording; the structure follows the reference: which parts
go in, in which order, error context first for code and last for tests,
other files by name only).  A model is never called here: responses come
from a table of recorded calls (J8) or from a user function applied to
Arrow batches (E1).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import py_list_repr, py_strip
from .planning import parse_plans
from .textops import diff_only

# Our own template text.
PLANNING_TASK = ("Choose the files needed to resolve the issue. Answer with one JSON object with the keys "
                 "relevant_files, source_files, test_files and is_test_generation_issue.")
CODE_TASK = "Rewrite the {lang}source file below so that it resolves the issue. Return the whole file, no fences."
TEST_TASK = "Rewrite the {lang}test file below with a few focused tests for the issue. Return the whole file, no fences."
COMMIT_TASK = "Write a short conventional commit message for these changes."
PATCH_TASK = "Return a unified diff (starting with 'diff --git') that resolves the problem, or nothing."
ERRORS_FIRST = "Errors of the last run (fix them first):\n\n"
ERRORS_LAST = "\n\n[Errors of the last run:]\n"
ERRORS_LAST_TAIL = "\nKeep passing tests only."


def _lang_word(lang: Column) -> Column:
    """``'Python '`` from ``python`` (str.capitalize + space); ``''`` if none."""
    cap = F.concat(F.upper(F.substring(lang, 1, 1)), F.lower(F.substring(lang, 2, 1 << 30)))
    return F.when(F.coalesce(lang, F.lit("")) == "", F.lit("")).otherwise(F.concat(cap, F.lit(" ")))


def _task(template: str, lang: Column | None) -> Column:
    if lang is None:
        return F.lit(template.replace("{lang}", ""))
    head, tail = template.split("{lang}")
    return F.concat(F.lit(head), _lang_word(lang), F.lit(tail))


def planning_prompt(issue: Column, candidates: Column) -> Column:
    return F.concat(F.lit(PLANNING_TASK + "\n\nIssue:\n"), issue, F.lit("\n\nCandidate files:\n"),
                    F.array_join(candidates, ", "))


def code_prompt(issue: Column, path: Column, content: Column, relevant: Column, errors: Column,
                language: Column) -> Column:
    err = F.when(F.coalesce(errors, F.lit("")) != "",
                 F.concat(F.lit(ERRORS_FIRST), py_strip(errors), F.lit("\n"))).otherwise(F.lit(""))
    others = py_list_repr(F.filter(relevant, lambda f: f != path))
    return F.concat(_task(CODE_TASK, language), F.lit("\n\n"), err, F.lit("Issue:\n"), issue,
                    F.lit("\n\nSource file: "), path, F.lit("\nCurrent content:\n"), content,
                    F.lit("\n\nOther relevant files (read only):\n"), others, F.lit("\n"))


def test_prompt(issue: Column, path: Column, content: Column, relevant: Column, errors: Column,
                language: Column) -> Column:
    err = F.when(F.coalesce(errors, F.lit("")) != "",
                 F.concat(F.lit(ERRORS_LAST), py_strip(errors), F.lit(ERRORS_LAST_TAIL))).otherwise(F.lit(""))
    others = py_list_repr(F.filter(relevant, lambda f: f != path))
    return F.concat(_task(TEST_TASK, language), F.lit("\n\nIssue:\n"), issue, F.lit("\n\nTest file: "), path,
                    F.lit("\nCurrent content:\n"), content, F.lit("\n\nOther relevant files (read only):\n"),
                    others, F.lit("\n"), err)


def commit_prompt(issue: Column, summary: Column) -> Column:
    return F.concat(F.lit(COMMIT_TASK + "\nIssue:\n"), issue, F.lit("\n\nFiles touched (first characters of each):\n"),
                    F.coalesce(summary, F.lit("")))


def patch_prompt(problem: Column) -> Column:
    return F.concat(F.lit(PATCH_TASK + "\n\nProblem:\n"), F.coalesce(problem, F.lit("")))


def build_prompts(df: DataFrame, template: str, **cols: str) -> DataFrame:
    """add a ``prompt`` column from one of the five templates
    (``planning``, ``code``, ``test``, ``commit``, ``patch``); ``cols`` maps
    the template's parts to column names."""
    c = {k: F.col(v) for k, v in cols.items()}
    fn = {"planning": planning_prompt, "code": code_prompt, "test": test_prompt,
          "commit": commit_prompt, "patch": patch_prompt}[template]
    return df.withColumn("prompt", fn(**c))


def replay_responses(prompts: DataFrame, calls: DataFrame, prompt_col: str = "prompt") -> DataFrame:
    """The recorded response of each prompt (``""`` when none), matched
    on ``sha2(prompt)``; repeated recordings of a prompt keep the first call.
    The dedup is an aggregate (partial + final), so a prompt recorded many
    times never lands whole in one task."""
    rec = (calls.groupBy(F.sha2(F.col("prompt"), 256).alias("_h"))
           .agg(F.min_by("response", "call_id").alias("response")))
    return (prompts.withColumn("_h", F.sha2(F.col(prompt_col), 256))
            .join(rec, "_h", "left").drop("_h")
            .withColumn("response", F.coalesce("response", F.lit(""))))


def _answered(prompts: DataFrame, responder, prompt_col: str) -> DataFrame:
    schema = T.StructType(prompts.schema.fields + [T.StructField("response", T.StringType())])

    def run(batches):
        for pdf in batches:
            out = responder(pdf[prompt_col])
            pdf["response"] = pd.Series(out, index=pdf.index).astype(object)
            yield pdf

    return prompts.mapInPandas(run, schema)


def respond_cached(prompts: DataFrame, responder: Callable[[pd.Series], pd.Series], store: str,
                   prompt_col: str = "prompt") -> DataFrame:
    """E1/J8 with a cache: the function sees each distinct prompt once, ever.

    ``store`` is a folder (Parquet, ``prompt_hash, response``).  Prompts are
    anti-joined against it by hash; the function runs on the distinct misses
    only, and their answers are appended under their hashes in one committed
    write, so a task that is repeated, or the whole call, adds nothing.  Two
    callers at once may both answer a prompt; readers then take one answer, the
    same for all (the least).  A NULL prompt is not asked and gets ``""``.
    """
    spark = prompts.sparkSession
    schema = "prompt_hash string, response string"
    h = F.sha2(F.col(prompt_col), 256)
    try:
        known = spark.read.schema(schema).parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = spark.createDataFrame([], schema)
    misses = prompts.filter(F.col(prompt_col).isNotNull()).groupBy(h.alias("prompt_hash")).agg(F.any_value(prompt_col).alias("_p")) \
        .join(known.select("prompt_hash"), "prompt_hash", "left_anti")
    _answered(misses, responder, "_p").select("prompt_hash", "response").write.mode("append").parquet(store)
    answers = spark.read.schema(schema).parquet(store).groupBy(F.col("prompt_hash").alias("_h")).agg(F.min("response").alias("response"))
    return prompts.withColumn("_h", h).join(answers, "_h", "left").drop("_h").withColumn("response", F.coalesce("response", F.lit("")))


def respond(prompts: DataFrame, responder: DataFrame | Callable[[pd.Series], pd.Series], mode: str = "default",
            prompt_col: str = "prompt", candidates_col: str | None = None) -> DataFrame:
    """The response of each prompt.

    ``responder`` is a table of recorded calls, replayed by a join (J8), or a
    function from a pandas Series of prompts to a Series of responses, applied
    to Arrow batches.
    ``mode='patch'`` then keeps only diffs (F15); ``mode='structured'``
    parses plans (F18) against ``candidates_col``.
    """
    if isinstance(responder, DataFrame):
        r = replay_responses(prompts, responder, prompt_col)
    else:
        r = _answered(prompts, responder, prompt_col)
    if mode == "patch":
        return r.withColumn("response", diff_only("response"))
    if mode == "structured":
        return parse_plans(r, "response", candidates_col or "candidates")
    return r
