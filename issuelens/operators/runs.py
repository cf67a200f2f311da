"""Retry/commit decisions per run, error carry-over, durations, profiles.

Skew: a single run (or agent) may own a large share of all attempt rows.
The ledger only ever keeps the first ``max_retries + 1`` attempts of a run,
so it starts with ``row_number() <= max_retries + 1``; Spark plans that as a
WindowGroupLimit that cuts every run to that many rows *before* the shuffle,
and nothing after it sees more than ``max_retries + 1`` rows per run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import epoch_micros

DECISIONS = ("retry", "end", "commit")


def _first_attempts(attempts: DataFrame, key: str, order, limit: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    # The filter must sit directly on the row_number() column for Spark to
    # plan the per-group limit before the shuffle.
    return (attempts.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= limit)
            .withColumn("attempt", (F.col("_rn") - 1).cast("bigint")).drop("_rn"))


def retry_ledger(attempts: DataFrame, max_retries: int = 3, commit: bool = True,
                 budget_scope: str = "run", key: str = "run_id", agent_key: str = "agent_id",
                 order=("ts", "event_id")) -> DataFrame:
    """The decision after every attempt, cut after the first terminal.

    ``tests_passed`` false → ``retry`` while the retry counter is below
    ``max_retries`` (so at most ``max_retries + 1`` attempts), else ``end``;
    true → ``commit`` when ``commit`` is enabled, else ``end``; NULL (no
    results, "not applicable") → ``end``.

    ``budget_scope='run'`` gives each run its own counter; ``'agent'`` shares
    one never-reset counter among all runs of an agent, runs taken in the
    order of their first attempt (W2).  Since every granted retry uses up one
    unit, only the first ``max_retries`` runs of an agent that fail at all can
    consume budget; the budget of any run is therefore computed from at most
    ``max_retries`` rows per agent.
    """
    limit = max_retries + 1
    failed = F.coalesce(F.col("tests_passed") == F.lit(False), F.lit(False))
    # Per-run values as window aggregates over the same partitioning: the
    # limited rows (at most ``limit`` per run) are not shuffled again.
    wk = Window.partitionBy(key)
    first = _first_attempts(attempts, key, order, limit).withColumn(
        "lead_fail", F.coalesce(F.min(F.when(~failed, F.col("attempt"))).over(wk), F.count(F.lit(1)).over(wk)))
    if budget_scope == "run":
        first = first.withColumn("budget", F.lit(max_retries).cast("bigint"))
    elif budget_scope == "agent":
        per_run = first.groupBy(key).agg(
            F.first(agent_key).alias("_agent_of_run"), F.first("lead_fail").alias("_lf"),
            F.struct(F.min(F.struct(*order)), F.col(key)).alias("run_order"))
        wa = Window.partitionBy("_agent_of_run").orderBy("run_order")
        consumers = (per_run.filter(F.col("_lf") > 0)
                     .withColumn("_rk", F.row_number().over(wa)).filter(F.col("_rk") <= max_retries)
                     .select(F.col("_agent_of_run").alias("_agent"), F.col("run_order").alias("_c_order"),
                             F.col("_lf").alias("_c_fail")))
        used = (per_run.join(consumers, (F.col("_agent_of_run") == F.col("_agent"))
                             & (F.col("_c_order") < F.col("run_order")), "left")
                .groupBy(key).agg(F.coalesce(F.sum("_c_fail"), F.lit(0)).alias("_used")))
        first = first.join(used, key).withColumn(
            "budget", (F.lit(max_retries) - F.least(F.lit(max_retries), F.col("_used"))).cast("bigint")) \
            .drop("_used")
    else:
        raise ValueError(f"budget_scope must be 'run' or 'agent', not {budget_scope!r}")
    n_retry = F.least(F.col("lead_fail"), F.col("budget"))
    passed = F.coalesce(F.col("tests_passed"), F.lit(False))
    decision = (F.when(F.col("attempt") < n_retry, "retry")
                .when(failed, "end")
                .when(passed & F.lit(commit), "commit")
                .otherwise("end"))
    return (first.filter(F.col("attempt") <= n_retry)
            .withColumn("decision", decision)
            .drop("lead_fail", "budget"))


def carry_errors(ledger: DataFrame, key: str = "run_id", order=("ts", "event_id")) -> DataFrame:
    """The errors an attempt is given: those of the attempt before it
    (every non-final ledger row is a retry; a terminal row clears them and
    nothing follows it).  Runs on the ledger, ≤ max_retries+1 rows per run."""
    w = Window.partitionBy(key).orderBy(*order)
    return ledger.withColumn("carried_errors", F.lag("errors").over(w))


def _micros(df: DataFrame, ts_col: str):
    return epoch_micros(df, ts_col)


def run_cuts(records: DataFrame, key: str, order, rows: int, most: int = 256) -> DataFrame:
    """Cut points of the large runs: ``(key, _cuts)``, sorted order tuples.

    The sketch of a run is its records whose hash of the order columns is a
    multiple of ``rows``: one in ``rows`` wherever they lie, so equal parts of
    the run's records, not of its time.  A run has at most ``most`` cuts, evenly
    thinned; a run below ``rows`` records has few or none."""
    picked = records.filter(F.pmod(F.xxhash64(*order), F.lit(rows)) == 0).groupBy(F.col(key).alias("_run")).agg(
        F.array_sort(F.collect_list(F.struct(*order))).alias("_all"))
    step = F.ceil(F.size("_all") / F.lit(most)).cast("int")
    places = F.sequence(F.lit(0), F.size("_all") - 1, step)
    return picked.select("_run", F.transform(places, lambda i: F.get("_all", i)).alias("_cuts"))


def _bucketed(records: DataFrame, key: str, order, rows: int, most: int = 256) -> DataFrame:
    """Adds ``_b``: the number of the run's cuts at or before the record."""
    cuts = run_cuts(records, key, order, rows, most)
    here = F.struct(*order)
    b = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= here)), F.lit(0))
    return records.join(cuts, F.col(key).eqNullSafe(F.col("_run")), "left").withColumn("_b", b).drop("_run", "_cuts")


def next_in_run(records: DataFrame, value, key: str = "run_id", order=("ts", "event_id"),
                buckets: int = 256, rows: int = 20_000) -> DataFrame:
    """Add ``_next``: ``value`` of the next record of the same run.

    Skew-safe form of ``lead(value) over (partition by key order by ...)``: a
    run of many records is cut into parts of about ``rows`` records (at most
    ``buckets`` cuts, see :func:`run_cuts`), however close in time they are, and ``lead`` runs inside
    each (run, part).  The last row of a part finds the first row of the
    run's next part as an extra row that is dropped afterwards.  The part is
    a plain function of the record and its run's cuts, so every branch of the
    plan agrees on it, and the result does not depend on the cuts.
    """
    x = _bucketed(records.withColumn("_v", value), key, order, rows, buckets)
    firsts = x.groupBy(key, "_b").agg(F.min(F.struct(*order, "_v")).alias("_f"))
    wk = Window.partitionBy(key).orderBy("_b")  # at most ``buckets`` + 1 rows of a run
    heads = firsts.select(key, F.lag("_b").over(wk).alias("_b"), "_f").filter(F.col("_b").isNotNull())
    extra = heads.select(F.col(key), *[F.col("_f")[c].alias(c) for c in order], F.col("_f")["_v"].alias("_v"), "_b",
                         F.lit(True).alias("_extra"))
    every = x.withColumn("_extra", F.lit(False)).unionByName(extra, allowMissingColumns=True)
    w = Window.partitionBy(key, "_b").orderBy("_extra", *order)
    return every.withColumn("_next", F.lead("_v").over(w)).filter(~F.col("_extra")).drop("_v", "_b", "_extra")


def ordered_pieces(texts: DataFrame, key: str, order, text: str, sep: str, rows: int = 20_000) -> DataFrame:
    """The long form of "the texts of a run in order, joined by ``sep``":
    ``(key, piece, offset, text)`` with pieces numbered from 0 and the place
    (in characters) at which each starts in the joined string.

    Numbers and places are prefix sums over the parts of a run
    (:func:`run_cuts`): inside a part by a window, over the parts by a window
    on their totals, so a run of any length is written by many tasks."""
    x = _bucketed(texts.withColumn("_len", F.char_length(text).cast("bigint") + F.lit(len(sep))), key, order, rows)
    w = Window.partitionBy(key, "_b").orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_n", F.row_number().over(w) - 1).withColumn("_at", F.coalesce(F.sum("_len").over(before), F.lit(0)))
    earlier = Window.partitionBy(F.col("_key")).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = x.groupBy(F.col(key).alias("_key"), F.col("_b").alias("_part")).agg(
        F.count("*").alias("_rows"), F.sum("_len").alias("_chars")).select(
        "_key", "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows"),
        F.coalesce(F.sum("_chars").over(earlier), F.lit(0)).alias("_chars"))
    return x.join(totals, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_part"))).select(
        key, (F.col("_rows") + F.col("_n")).cast("bigint").alias("piece"),
        (F.col("_chars") + F.col("_at")).cast("bigint").alias("offset"), F.col(text).alias("text"))


def step_durations(records: DataFrame, key: str = "run_id", ts: str = "ts",
                   order=("ts", "event_id"), skew_safe: bool = True) -> DataFrame:
    """Seconds from each record to the next record of the same run
    (NULL for the last).  ``skew_safe`` (default) uses :func:`next_in_run`;
    ``False`` is the plain window, one run per task."""
    if skew_safe:
        out = next_in_run(records, _micros(records, ts), key, order)
    else:
        out = records.withColumn("_next", F.lead(_micros(records, ts)).over(Window.partitionBy(key).orderBy(*order)))
    return out.withColumn("step_seconds", (F.col("_next") - _micros(records, ts)) / F.lit(1_000_000.0)) \
        .drop("_next")


def run_spans(records: DataFrame, key: str = "run_id", ts: str = "ts") -> DataFrame:
    """First record, last record and span in seconds per run (partial +
    final aggregate, no sort)."""
    return records.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_records"),
        ((F.max(_micros(records, ts)) - F.min(_micros(records, ts))) / F.lit(1_000_000.0)).alias("span_seconds"))


# Levels printed by the log format, the markers of a phase
# start, of a model call and of a granted retry in the message text, and the
# phase names counted on their own.
LEVELS = ["INFO", "WARNING", "ERROR", "DEBUG", "CRITICAL"]
PHASE_RE = r"^=+ starting ([A-Za-z_]+) phase =+$"
CALL_MARK = "agent_respond()"
RETRY_PREFIX = "Tests did not pass. Retrying"
CHECK_PHASE = "test_and_lint"
CODE_PHASE = "code_generation"
TEST_GEN_PHASE = "test_generation"


def trace_profile(records: DataFrame, key: str = "run_id", level: str = "level",
                  message: str = "message", levels=LEVELS) -> DataFrame:
    """A10: records per run × level (a pivot with fixed values, so no extra
    pass to discover them), phases entered (all, checks, code generation,
    test generation), model calls and granted retries."""
    counts = [F.count_if(F.col(level) == lv).cast("bigint").alias(f"n_{lv.lower()}") for lv in levels]
    phase = F.regexp_extract(F.col(message), PHASE_RE, 1)
    n = lambda cond, name: F.count_if(cond).cast("bigint").alias(name)
    return records.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_records"), *counts,
        n(F.col(message).rlike(PHASE_RE), "n_phases"),
        n(phase == CHECK_PHASE, "n_check_phases"),
        n(phase == CODE_PHASE, "n_code_phases"),
        n(phase == TEST_GEN_PHASE, "n_test_gen_phases"),
        n(F.col(message).contains(CALL_MARK), "n_calls"),
        n(F.col(message).startswith(RETRY_PREFIX), "n_retries"))
