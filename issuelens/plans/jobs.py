"""Composed jobs: the stages of one issue's workflow, applied to tables.

Each job is a plain composition of operators (DataFrames in, DataFrames
out); Catalyst plans the whole chain, and laziness ends only at the
caller's sink.  Shuffle keys along the way: ``(repo, key)`` for test
matching, ``issue_id``/``run_id`` for candidates and plans, ``(repo, path)``
for file existence and content.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import benchmark as B
from ..operators import outcomes as O
from ..operators import planning as P
from ..operators import retrieval as R


def heuristic_plans(issues: DataFrame, inventory: DataFrame, language_ctx: Column | None = None) -> DataFrame:
    """Issues → candidates (no all-files fallback) → plan lists per issue,
    with the project's language text in ``language_ctx``."""
    cands = R.candidate_files(issues, inventory, fallback_all=False, dedupe=False)
    p = P.plans_from_candidates(cands)
    return p.withColumn("language_ctx", language_ctx if language_ctx is not None else F.lit(None).cast("string"))


def prepared_plans(plans: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Language (F12) → inferred test file for plans without one (F13) →
    bare names placed in the repository's test directory (F11)."""
    return P.normalize_test_paths(P.infer_test_files(P.with_language(plans)), snapshot)


@dataclass
class CheckPlan:
    """What a run will check: tests that exist (J3) with their commands
    (F22), and the files to lint (F10)."""

    tests: DataFrame
    worklist: DataFrame
    lint: DataFrame


def check_plan(plans: DataFrame, snapshot: DataFrame, repo_config: DataFrame) -> CheckPlan:
    tests = P.effective_tests(plans, snapshot)
    return CheckPlan(tests, P.check_worklist(tests, repo_config), P.lint_targets(plans))


@dataclass
class CheckOutcome:
    verdicts: DataFrame
    outputs: DataFrame


def check_outcome(checks: DataFrame, plans: DataFrame | None = None) -> CheckOutcome:
    """Checks → verdict per run (A4-A6) and output maps (A3)."""
    return CheckOutcome(O.run_verdict(checks, plans), O.outputs_by_run(checks))


@dataclass
class BenchmarkRun:
    results: DataFrame
    quarantine: DataFrame


def benchmark_run(instances: DataFrame, runs: DataFrame) -> BenchmarkRun:
    """Instances → validation (F1) → results joined with the runs
    plus a quarantine of skipped instances."""
    return BenchmarkRun(*B.collect_results(instances, runs))
