"""Check outputs → per-run verdicts, error digests and changed-file sets.

Input ``checks``: ``run_id, seq, kind ('test'|'lint'), file, exit_code,
stdout, stderr, error`` – one row per executed check (``error`` holds the
exception text when the check could not run).  All aggregations are keyed
by ``run_id`` and planned as partial + final hash aggregates; the arrays
they build are bounded by the checks of one run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import array_size
from .runs import ordered_pieces

# The marker of an empty test run and the blank line between the
# texts of a digest.
NO_TESTS_RAN = "no tests ran"
DIGEST_SEPARATOR = "\n\n"


def format_outputs(checks: DataFrame) -> DataFrame:
    """the stored text of each check.

    ``[Exit code: n]\\nSTDOUT:\\n…\\nSTDERR:\\n…``, or ``Test error: …`` /
    ``Lint error: …`` when the check raised.
    """
    text = F.when(F.col("error").isNotNull(),
                  F.concat(F.when(F.col("kind") == "test", "Test error: ").otherwise("Lint error: "),
                           F.col("error"))
                  ).otherwise(F.concat(F.lit("[Exit code: "), F.col("exit_code").cast("string"),
                                       F.lit("]\nSTDOUT:\n"), F.coalesce("stdout", F.lit("")),
                                       F.lit("\nSTDERR:\n"), F.coalesce("stderr", F.lit(""))))
    return checks.withColumn("output", text)


def parse_outputs(outputs: DataFrame, col: str = "output") -> DataFrame:
    """F23 inverse: exit code, stdout, stderr and pytest counts from text.

    The older form that holds only ``[Exit code: n]`` parses with null
    stdout/stderr.
    """
    t = F.col(col)
    has_body = t.contains("\nSTDOUT:\n")
    num = lambda p: F.regexp_extract(t, p, 1)
    as_long = lambda p: F.when(num(p) != "", num(p).try_cast("bigint"))
    return outputs.select(
        "*",
        as_long(r"^\[Exit code: (-?[0-9]+)\]").alias("parsed_exit_code"),
        F.when(has_body, F.regexp_extract(t, r"(?s)\nSTDOUT:\n(.*)\nSTDERR:\n", 1)).alias("parsed_stdout"),
        F.when(has_body, F.regexp_extract(t, r"(?s)\nSTDERR:\n(.*)$", 1)).alias("parsed_stderr"),
        as_long(r"([0-9]+) failed").alias("n_failed"),
        as_long(r"([0-9]+) passed").alias("n_passed"),
        F.when(num(r" in ([0-9]+(\.[0-9]+)?)s") != "",
               num(r" in ([0-9]+(\.[0-9]+)?)s").try_cast("double")).alias("test_seconds"))


def latest_per_file(checks: DataFrame) -> DataFrame:
    """The last check of each (run, kind, file) by ``seq``.

    Expressed as ``max_by`` over a struct so it plans as a partial + final
    aggregate (map-side combine, skew-tolerant) instead of a sorted window.
    """
    cols = [c for c in checks.columns if c not in ("run_id", "kind", "file")]
    last = F.max_by(F.struct(*cols), F.col("seq"))
    return checks.groupBy("run_id", "kind", "file").agg(last.alias("_l")).select(
        "run_id", "kind", "file", *[F.col(f"_l.{c}").alias(c) for c in cols])


def outputs_by_run(checks: DataFrame) -> DataFrame:
    """A3: per run, ``test_outputs`` and ``lint_outputs`` maps file → text;
    a file checked twice keeps its last output."""
    last = format_outputs(latest_per_file(checks))
    entry = F.struct("file", "output")
    return last.groupBy("run_id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("kind") == "test", entry))).alias("test_outputs"),
        F.map_from_entries(F.collect_list(F.when(F.col("kind") == "lint", entry))).alias("lint_outputs"))


def output_rows(checks: DataFrame) -> DataFrame:
    """A3 in long form: (run_id, kind, file, output), one pass over the checks."""
    return format_outputs(latest_per_file(checks)).select("run_id", "kind", "file", "output")


def _failure_text() -> "F.Column":
    k, f = F.col("kind"), F.col("file")
    return (F.when((k == "test") & F.col("error").isNotNull(),
                   F.concat(F.lit("Test error in "), f, F.lit(": "), F.col("error")))
            .when(k == "test", F.concat(F.lit("Test failure in "), f, F.lit(":\n"), F.coalesce("stdout", F.lit("")),
                                        F.lit("\n"), F.coalesce("stderr", F.lit(""))))
            .when(F.col("error").isNotNull(), F.concat(F.lit("Lint error in "), f, F.lit(": "), F.col("error")))
            .otherwise(F.concat(F.lit("Lint failure in "), f, F.lit(": Exit code "),
                                F.col("exit_code").cast("string"))))


def _failed() -> "F.Column":
    return F.col("error").isNotNull() | (F.coalesce(F.col("exit_code"), F.lit(0)) != 0)


def error_digest(checks: DataFrame) -> DataFrame:
    """Failure texts of a run, tests first then lint, in run order,
    joined by a blank line; NULL when nothing failed."""
    item = F.struct(F.when(F.col("kind") == "test", 0).otherwise(1).alias("k"), F.col("seq"),
                    _failure_text().alias("t"))
    texts = F.sort_array(F.collect_list(F.when(_failed(), item)))
    return checks.groupBy("run_id").agg(
        F.when(F.size(texts) > 0, F.array_join(F.transform(texts, lambda x: x["t"]), DIGEST_SEPARATOR)).alias("last_errors"))


def error_pieces(checks: DataFrame, rows: int = 20_000) -> DataFrame:
    """A6 in long form: ``(run_id, piece, offset, text)``, one row per failure;
    the texts of a run in the order of ``piece``, joined by a blank line, are
    its digest.  A run without failures has no row."""
    failed = checks.filter(_failed()).select(
        "run_id", F.when(F.col("kind") == "test", 0).otherwise(1).alias("_k"), "seq", _failure_text().alias("_t"))
    return ordered_pieces(failed.filter("_t IS NOT NULL"), "run_id", ("_k", "seq", "_t"), "_t", DIGEST_SEPARATOR, rows)


def run_verdict(checks: DataFrame, plans: DataFrame | None = None, variant: str = "modular") -> DataFrame:
    """A4 + A5 + A6: the verdict table, rows checked in this order.

    1. the plan has no relevant files → no results, ``passed`` NULL
    2. no check was run at all (no test file exists) → tests and lint pass
       with no outputs, ``passed`` and ``last_errors`` unchanged (NULL).  A run
       with lint checks only had test files that were all skipped: row 4
    3. some test output (last per file) contains "no tests ran" → tests
       pass, lint real, ``passed`` true, ``last_errors`` unchanged
    4. otherwise: every exit code 0 and no exception, per kind; ``passed`` =
       both; ``last_errors`` = digest

    ``variant="class"`` (the single-class implementation) has rows 1 and 4
    only.  ``rule`` names the row that applied.  One scan of ``checks`` and a
    two-level aggregate: per (run, kind, file) — last output, count, all
    passed, failure texts — then per run; both levels combine map-side.
    """
    is_test = F.col("kind") == "test"
    item = F.struct(F.when(is_test, 0).otherwise(1).alias("k"), F.col("seq"), _failure_text().alias("t"))
    per_file = format_outputs(checks).groupBy("run_id", "kind", "file").agg(
        F.count(F.lit(1)).alias("_n"),
        F.bool_and(~_failed()).alias("_ok"),
        F.max_by("output", "seq").alias("_last"),
        F.collect_list(F.when(_failed(), item)).alias("_fails"))
    is_test = F.col("kind") == "test"
    texts = F.sort_array(F.flatten(F.collect_list("_fails")))
    v = per_file.groupBy("run_id").agg(
        F.sum("_n").alias("_n_checks"),
        F.coalesce(F.bool_and(F.when(is_test, F.col("_ok"))), F.lit(True)).alias("_tests_ok"),
        F.coalesce(F.bool_and(F.when(~is_test, F.col("_ok"))), F.lit(True)).alias("_lint_ok"),
        F.coalesce(F.bool_or(F.when(is_test, F.lower("_last").contains(NO_TESTS_RAN))), F.lit(False))
        .alias("_no_tests_ran"),
        F.when(F.size(texts) > 0, F.array_join(F.transform(texts, lambda x: x["t"]), DIGEST_SEPARATOR)).alias("last_errors"))
    if plans is not None:
        rel = plans.select("run_id", (F.coalesce(array_size("relevant_files"), F.lit(0)) > 0).alias("_has_rel"))
        v = rel.join(v, "run_id", "left")
    else:
        v = v.withColumn("_has_rel", F.lit(True))
    if variant == "class":
        rule = F.when(~F.col("_has_rel"), 1).otherwise(4)
    elif variant == "modular":
        rule = (F.when(~F.col("_has_rel"), 1).when(F.coalesce(F.col("_n_checks"), F.lit(0)) == 0, 2)
                .when(F.coalesce("_no_tests_ran", F.lit(False)), 3).otherwise(4))
    else:
        raise ValueError(f"variant must be 'modular' or 'class', not {variant!r}")
    v = v.withColumn("rule", rule)
    r = F.col("rule")
    # A run without checks (class variant) has nothing that failed.
    ok = {c: F.coalesce(c, F.lit(True)) for c in ("_tests_ok", "_lint_ok")}
    return v.select(
        "run_id", r.alias("rule"),
        F.when(r == 1, F.lit(None)).when(r.isin(2, 3), True).otherwise(ok["_tests_ok"]).alias("tests_passed"),
        F.when(r == 1, F.lit(None)).when(r == 2, True).otherwise(ok["_lint_ok"]).alias("lint_passed"),
        F.when(r.isin(1, 2), F.lit(None)).when(r == 3, True)
         .otherwise(ok["_tests_ok"] & ok["_lint_ok"]).alias("passed"),
        F.when(r == 4, F.col("last_errors")).alias("last_errors"))


def first_seen(events: DataFrame, key: str, item: str, order=("ts", "event_id")) -> DataFrame:
    """The first occurrence of each (key, item), by ``order``."""
    return events.groupBy(key, item).agg(F.min(F.struct(*order)).alias("first"))


def updated_files(change_events: DataFrame, key: str = "run_id", item: str = "file",
                  order=("ts", "event_id")) -> DataFrame:
    """Files updated across phases and attempts, duplicates skipped,
    first-seen order kept (``updated_files`` array per run)."""
    fs = first_seen(change_events, key, item, order)
    ordered = F.sort_array(F.collect_list(F.struct(F.col("first"), F.col(item))))
    return fs.groupBy(key).agg(F.transform(ordered, lambda x: x[item]).alias("updated_files"))


def changed_files(changes: DataFrame) -> DataFrame:
    """distinct(created_file ∪ updated_files), sorted (the reference's
    order is unspecified)."""
    both = F.concat(F.array_compact(F.array(F.col("created_file"))),
                    F.coalesce(F.col("updated_files"), F.array().cast("array<string>")))
    return changes.withColumn("changed_files", F.sort_array(F.array_distinct(both)))
