"""The retry ledger (W1) as a stateful stream.

State per run: ``retry_count``, ``attempt`` (attempts seen), ``closed`` (a
terminal decision was made) and ``last_errors`` (of the attempt before).  Attempts of one run must arrive in time
order across micro-batches (within a batch they are sorted here).  Memory
per group is bounded: at most ``max_retries + 1`` attempts of a run can
ever be decided, so each Arrow chunk of a group is cut to its earliest
``remaining`` rows before they are merged.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

OUTPUT_SCHEMA = "run_id long, event_id long, attempt long, decision string, carried_errors string"
STATE_SCHEMA = "retry_count long, attempt long, closed boolean, last_errors string"


def _decide(max_retries: int, commit: bool):
    limit = max_retries + 1

    def fn(key, chunks, state):
        retry_count, attempt, closed, last_errors = state.get if state.exists else (0, 0, False, None)
        if closed:
            return
        keep = None
        for pdf in chunks:
            part = pdf.nsmallest(limit - attempt, ["ts", "event_id"]) if len(pdf) else pdf
            keep = part if keep is None else pd.concat([keep, part]).nsmallest(limit - attempt, ["ts", "event_id"])
        rows = []
        if keep is not None:
            for r in keep.sort_values(["ts", "event_id"]).itertuples(index=False):
                tp = r.tests_passed
                if tp is None or pd.isna(tp):
                    decision, closed = "end", True
                elif not bool(tp):
                    if retry_count < max_retries:
                        decision, retry_count = "retry", retry_count + 1
                    else:
                        decision, closed = "end", True
                else:
                    decision, closed = ("commit" if commit else "end"), True
                rows.append((int(key[0]), int(r.event_id), attempt, decision, last_errors))
                last_errors = None if closed or pd.isna(r.errors) else r.errors
                attempt += 1
                if closed:
                    break
        state.update((retry_count, attempt, closed, last_errors))
        if rows:
            yield pd.DataFrame(rows, columns=["run_id", "event_id", "attempt", "decision", "carried_errors"])

    return fn


def stream_retry_ledger(attempts: DataFrame, max_retries: int = 3, commit: bool = True) -> DataFrame:
    """Streaming decisions ``(run_id, event_id, attempt, decision,
    carried_errors)``; the last as W3 gives it.

    ``attempts`` is a streaming DataFrame with ``run_id, event_id, ts,
    tests_passed, errors``.
    """
    return attempts.select("run_id", "event_id", "ts", "tests_passed", "errors").groupBy("run_id") \
        .applyInPandasWithState(_decide(max_retries, commit), OUTPUT_SCHEMA, STATE_SCHEMA, "append",
                                GroupStateTimeout.NoTimeout)


EXPIRING_STATE = "retry_count long, attempt long, closed boolean, last_errors string, last_us long, waiting string"


def _bounded(waiting: list, limit: int, idle_us: int) -> list:
    """Of each stretch of attempts without a longer pause than ``idle_us`` the
    first ``limit``; the last of them carries the end of the stretch."""
    kept, size, end = [], 0, None
    for us, event, passed, errors, until in sorted(waiting, key=lambda x: x[:2]):
        size = 1 if end is None or us - end > idle_us else size + 1
        end = until if size == 1 else max(end, until)
        if size <= limit:
            kept.append([us, event, passed, errors, until])
        else:
            kept[-1][4] = end
    return kept


#: What is known of a run before its first attempt: the fields of EXPIRING_STATE, with the list in place of its text.
NEW_RUN = (0, 0, True, None, None, [])


def _attempts(pdf) -> list:
    """The rows of a chunk as waiting attempts."""
    passed = [None if p is None or pd.isna(p) else bool(p) for p in pdf["tests_passed"].tolist()]
    errors = [None if e is None or e != e else e for e in pdf["errors"].tolist()]
    return [[int(us), int(event), p, e, int(us)] for us, event, p, e in zip(pdf["us"].tolist(), pdf["event_id"].tolist(), passed, errors)]


def _advance(run: int, fields, max_retries: int, commit: bool, idle_us: int, passed_us: int) -> tuple[list, tuple | None]:
    """The rows a run gives once the watermark has passed ``passed_us``, and
    its fields after that; None if nothing is left to be known."""
    retry_count, attempt, closed, last_errors, last_us, waiting = fields
    rows, k = [], 0
    while k < len(waiting) and waiting[k][0] < passed_us:
        us, event, passed, errors, until = waiting[k]
        k += 1
        if last_us is None or us - last_us > idle_us:
            if not closed:
                rows.append((run, None, attempt, "expired", last_errors))
            retry_count, attempt, closed, last_errors = 0, 0, False, None
        last_us = until if last_us is None else max(last_us, until)
        if closed:
            continue
        if passed is False and retry_count < max_retries:
            decision, retry_count = "retry", retry_count + 1
        else:
            decision, closed = ("commit" if passed and commit else "end"), True
        rows.append((run, event, attempt, decision, last_errors))
        last_errors, attempt = (None if closed else errors), attempt + 1
    if k == len(waiting) and last_us + idle_us < passed_us:
        if not closed:
            rows.append((run, None, attempt, "expired", last_errors))
        return rows, None
    return rows, (retry_count, attempt, closed, last_errors, last_us, waiting[k:])


def _due(fields, idle_us: int) -> int:
    """The time the watermark has to pass for a run to change."""
    return min([x[0] for x in fields[5][:1]] + ([] if fields[4] is None else [fields[4] + idle_us]))


def _ledger(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["run_id", "event_id", "attempt", "decision", "carried_errors"])
    out["event_id"] = pd.array([r[1] for r in rows], dtype="Int64")
    return out


def _expiring(max_retries: int, commit: bool, idle_us: int):
    """A state per run."""
    def fn(key, chunks, state):
        if key[0] is None or pd.isna(key[0]):
            return  # a heartbeat only moves the watermark
        *known, waiting = state.get if state.exists else (*NEW_RUN[:5], "[]")
        waiting = json.loads(waiting)
        for pdf in chunks:
            if len(pdf):
                waiting = _bounded(waiting + _attempts(pdf), max_retries + 1, idle_us)
        passed_us = state.getCurrentWatermarkMs() * 1000
        rows, left = _advance(int(key[0]), (*known, waiting), max_retries, commit, idle_us, passed_us)
        if left is not None:
            state.update((*left[:5], json.dumps(left[5])))
            state.setTimeoutTimestamp(max(_due(left, idle_us) // 1000, passed_us // 1000) + 1)
        elif state.exists:
            state.remove()
        if rows:
            yield _ledger(rows)

    return fn


def _expiring_shard(max_retries: int, commit: bool, idle_us: int):
    """A state per shard: the fields of each of its runs that is still known."""
    def fn(key, chunks, state):
        if key[0] is None or pd.isna(key[0]):
            return
        runs = {run: fields for run, *fields in json.loads(state.get[0])} if state.exists else {}
        for pdf in chunks:
            new = {}
            if len(pdf):
                for run, attempt in zip(pdf["run_id"].tolist(), _attempts(pdf)):
                    new.setdefault(int(run), []).append(attempt)
            for run, attempts in new.items():
                *known, waiting = runs.get(run, NEW_RUN)
                runs[run] = (*known, _bounded(waiting + attempts, max_retries + 1, idle_us))
        passed_us = state.getCurrentWatermarkMs() * 1000
        rows, left = [], {}
        for run, fields in runs.items():
            more, fields = _advance(run, fields, max_retries, commit, idle_us, passed_us)
            rows += more
            if fields is not None:
                left[run] = fields
        if left:
            state.update((json.dumps([[run, *fields] for run, fields in left.items()]),))
            state.setTimeoutTimestamp(max(min(_due(x, idle_us) for x in left.values()) // 1000, passed_us // 1000) + 1)
        elif state.exists:
            state.remove()
        if rows:
            yield _ledger(rows)

    return fn


def stream_expiring_ledger(attempts: DataFrame, delay: str, idle_seconds: int, max_retries: int = 3,
                           commit: bool = True, shards: int | None = None) -> DataFrame:
    """X2 with event time: attempts may arrive in any order within ``delay``,
    and abandoned runs close.

    An attempt is decided once the watermark has passed its time, so no
    earlier one can follow; until then it waits in the run's state, which
    holds ``max_retries + 1`` undecided attempts at most of each stretch
    without a pause.  A run without a terminal decision that pauses for more
    than ``idle_seconds`` of event time gets a row ``expired`` (no event, the
    number of attempts, the errors of the last one); its state, and that of a
    closed run, is removed then, and a later attempt opens the run anew.  An
    attempt that arrives later than ``delay`` is dropped.

    Rows without a run id are heartbeats: they move the watermark only, so a
    source that falls silent can still have its runs closed.

    A state, and a call of Python per micro-batch, is that of a run, or with
    ``shards`` that of all runs whose hash falls in one of so many shards: a
    call costs some milliseconds, so a stream of many runs should have some
    tens of them in a shard.  The rows are the same; the number of shards has
    to stay over restarts.
    """
    ts = F.col("ts").cast("timestamp")
    timed = attempts.select("run_id", "event_id", ts.alias("ts"), F.unix_micros(ts).alias("us"), "tests_passed", "errors") \
        .withWatermark("ts", delay)
    if shards:
        shard = F.when(F.col("run_id").isNotNull(), F.pmod(F.xxhash64("run_id"), F.lit(shards)))
        return timed.withColumn("shard", shard).groupBy("shard").applyInPandasWithState(
            _expiring_shard(max_retries, commit, idle_seconds * 1_000_000), OUTPUT_SCHEMA, "runs string", "append",
            GroupStateTimeout.EventTimeTimeout)
    return timed.groupBy("run_id").applyInPandasWithState(
        _expiring(max_retries, commit, idle_seconds * 1_000_000), OUTPUT_SCHEMA, EXPIRING_STATE, "append",
        GroupStateTimeout.EventTimeTimeout)
