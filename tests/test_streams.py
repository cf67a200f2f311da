"""The retry ledger with event time: order, expiry, state."""

import datetime as dt
import random

import pytest

from issuelens.operators.runs import carry_errors, retry_ledger
from issuelens.session import scratch_path
from issuelens.streaming.log_tail import run_to_parquet
from issuelens.streaming.retry_state import stream_expiring_ledger

ATTEMPTS = "run_id long, event_id long, ts timestamp, tests_passed boolean, errors string"
T0 = dt.datetime(2024, 1, 1, 12)


def stream(spark, slices, delay, idle):
    """Rows and last progress of the ledger over slices, one per micro-batch."""
    src, out, ckpt = (scratch_path(spark, n) for n in ("in", "out", "ckpt"))
    for rows in slices:
        spark.createDataFrame(rows, ATTEMPTS).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", "1").parquet(src)
    q = run_to_parquet(stream_expiring_ledger(s, delay, idle), out, ckpt)
    q.awaitTermination()
    return spark.read.parquet(out).collect(), q.recentProgress


def beat(minutes):
    return [(None, None, T0 + dt.timedelta(minutes=minutes), None, None)]


def key(r):
    return tuple((v is None, v) for v in r)


def test_shuffled_slices_equal_batch_and_state_is_emptied(spark):
    r = random.Random(1)
    rows = []
    for run in range(30):
        for i in range(r.randint(1, 7)):
            passed = r.choice([False, False, True, None])
            rows.append((run, run * 100 + i, T0 + dt.timedelta(seconds=r.randint(0, 3000)), passed, f"e{run}.{i}"))
    rows += [(99, 9900 + i, T0 + dt.timedelta(minutes=i), False, f"last {i}") for i in range(3)]  # never ends
    arrival = sorted(rows, key=lambda x: x[2] + dt.timedelta(seconds=r.randint(0, 600)))
    cut = [arrival[i::1][:len(arrival) // 5 + 1] for i in range(0, len(arrival), len(arrival) // 5 + 1)]
    for part in cut:
        r.shuffle(part)
    got, progress = stream(spark, [*cut, beat(300)], "10 minutes", 7200)
    df = spark.createDataFrame(rows, ATTEMPTS)
    led = carry_errors(retry_ledger(df.selectExpr("*", "run_id AS agent_id")))
    want = [tuple(x) for x in led.select("run_id", "event_id", "attempt", "decision", "carried_errors").collect()]
    left = {}
    for x in led.collect():
        left.setdefault(x.run_id, []).append(x)
    for run, xs in left.items():
        xs.sort(key=lambda x: x.attempt)
        if xs[-1].decision == "retry":
            want.append((run, None, len(xs), "expired", xs[-1].errors))
    assert (99, None, 3, "expired", "last 2") in want
    assert sorted((tuple(x) for x in got), key=key) == sorted(want, key=key)
    states = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert max(states) > 0 and states[-1] == 0


def at(run, event, minutes, passed, errors="x"):
    return (run, event, T0 + dt.timedelta(minutes=minutes), passed, errors)


def test_late_attempts_drop_and_expired_runs_open_anew(spark):
    slices = [[at(1, 10, 0, False), at(2, 20, 0, True)],
              [at(1, 11, 30, False), at(2, 21, 31, False)],   # run 2 is closed
              [at(3, 30, 60, False)],
              [at(1, 9, 1, True)],                            # behind the watermark
              beat(500),
              [at(1, 12, 500, True)], beat(900)]
    got, progress = stream(spark, slices, "5 minutes", 3600)
    assert sorted((tuple(x)[:4] for x in got), key=key) == sorted([
        (1, 10, 0, "retry"), (1, 11, 1, "retry"), (1, None, 2, "expired"), (1, 12, 0, "commit"),
        (2, 20, 0, "commit"), (3, 30, 0, "retry"), (3, None, 1, "expired")], key=key)
    assert [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]][-1] == 0


@pytest.mark.parametrize("n", [4, 50])
def test_waiting_attempts_are_bounded(spark, n):
    """A run with many undecided attempts keeps the earliest four."""
    from issuelens.streaming.retry_state import _expiring
    import pandas as pd

    class State:
        exists, value = False, None
        get = property(lambda s: s.value)

        def update(self, v):
            self.exists, self.value = True, v

        def getCurrentWatermarkMs(self):
            return 0

        def setTimeoutTimestamp(self, ms):
            assert ms > 0
    s = State()
    idle = 10**9
    chunk = pd.DataFrame({"us": range(n * 10**6, 0, -10**6), "event_id": range(n), "tests_passed": [False] * n, "errors": [None] * n})
    assert list(_expiring(3, True, idle)((1,), [chunk[: n // 2], chunk[n // 2:]], s)) == []
    import json
    waiting = json.loads(s.value[5])
    assert [x[0] for x in waiting] == [10**6 * k for k in range(1, 5)] and waiting[-1][4] == n * 10**6


# -- whole records -----------------------------------------------------------

PARTS = "source_file string, offset long, text string, is_last boolean"
LOG = ("Loading settings\ndone\r\n2024-01-02 03:04:05,678 [INFO] first\n  more of it\n\nend\r\r\n"
       "2024-13-45 03:04:06,000 [ERROR] no date\nTraceback é 漢字:\n  line\n"
       "2024-01-02 03:04:07,000 [DEBUG] \n2024-01-02 03:04:08,000 [INFO] last\nwith a tail")


def cuts(text, at):
    """Parts (offset, text, is_last) of a text cut at the given characters."""
    ends = [0, *sorted(at), len(text)]
    return [(len(text[:a].encode()), text[a:b], b == len(text)) for a, b in zip(ends, ends[1:])]


def batch_records(spark, path):
    from issuelens.sources.logs import read_run_logs
    return sorted(tuple(r) for r in read_run_logs(spark, path).select("line_no", "ts", "level", "message").collect())


def follow(parts, batches):
    """The records the state function gives for parts dealt to batches."""
    import pandas as pd
    from issuelens.streaming.whole_records import _follow

    class State:
        exists, value = False, None
        get = property(lambda s: s.value)

        def update(self, v):
            self.exists, self.value = True, v
    s, out = State(), []
    for b in batches:
        pdf = pd.DataFrame([parts[k] for k in b], columns=["offset", "text", "is_last"])
        for got in _follow(("f",), [pdf], s):
            out += [tuple(r)[1:] for r in got.itertuples(index=False)]
    return out, s.value


def test_a_log_cut_anywhere_gives_the_same_records():
    whole, _ = follow(cuts(LOG, []), [[0]])
    assert [n for n, *_ in whole] == [1, 2, 3, 8, 11, 12] and [k for _, k, _ in whole] == [False, False, True, True, True, True]
    for at in range(1, len(LOG)):
        parts = cuts(LOG, [at])
        for batches in ([[0], [1]], [[1], [0]], [[0, 1]], [[1], [1, 0], [0]]):
            got, state = follow(parts, batches)
            assert got == whole, (at, batches)
            assert state[5] and state[3] == "" and state[4] == "[]"
    r = random.Random(7)
    for _ in range(200):
        parts = cuts(LOG, r.sample(range(1, len(LOG)), 9))
        order = list(range(len(parts)))
        r.shuffle(order)
        assert follow(parts, [[k] for k in order])[0] == whole


def test_stream_of_parts_equals_the_batch_reader(spark):
    import os
    folder = scratch_path(spark, "log")
    os.makedirs(folder.removeprefix("file:"))
    with open(folder.removeprefix("file:") + "/a.log", "w", newline="") as f:
        f.write(LOG)
    r = random.Random(8)
    rows = [(name, *p) for name in ("a", "b", "c") for p in cuts(LOG, r.sample(range(1, len(LOG)), 12))]
    rows += [(None, 0, "x", True), ("a", None, "x", True), ("never", 10, "waits", False), ("a", 0, "again", False)]
    r.shuffle(rows)
    rows.sort(key=lambda x: x[2] == "again")  # a part that comes twice, with another text
    src, out, ckpt = (scratch_path(spark, n) for n in ("in", "out", "ckpt"))
    for k in range(0, len(rows), 9):
        spark.createDataFrame(rows[k:k + 9], PARTS).coalesce(1).write.mode("append").parquet(src)
    from issuelens.streaming.whole_records import stream_whole_records
    s = spark.readStream.schema(PARTS).option("maxFilesPerTrigger", "1").parquet(src)
    run_to_parquet(stream_whole_records(s), out, ckpt).awaitTermination()
    got = {}
    for x in spark.read.parquet(out).collect():
        got.setdefault(x.source_file, []).append(tuple(x)[1:])
    want = batch_records(spark, folder)
    assert set(got) == {"a", "b", "c"} and all(sorted(v, key=lambda x: x[0]) == want for v in got.values())


# -- shards of runs ----------------------------------------------------------

def ledger(spark, slices, delay, idle, **how):
    """As :func:`stream`, with the most states of a batch."""
    src, out, ckpt = (scratch_path(spark, n) for n in ("in", "out", "ckpt"))
    for rows in slices:
        spark.createDataFrame(rows, ATTEMPTS).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", "1").parquet(src)
    q = run_to_parquet(stream_expiring_ledger(s, delay, idle, **how), out, ckpt)
    q.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return sorted((tuple(x) for x in spark.read.parquet(out).collect()), key=key), max(states), states[-1]


def test_shards_give_the_rows_of_runs(spark):
    r = random.Random(3)
    rows = [(run, run * 1000 + i, T0 + dt.timedelta(minutes=r.randint(0, 600)), r.choice([False, False, False, True, None]),
             r.choice([None, f'"e", {run}.{i}'])) for run in range(-5, 35) for i in range(r.randint(1, 12))]
    r.shuffle(rows)
    rows.sort(key=lambda x: x[2] + dt.timedelta(minutes=r.randint(0, 30)))
    slices = [rows[:100], rows[100:200] + beat(0), rows[200:], beat(700), [at(7, 1, 800, False), *rows[:3]], beat(2000)]
    runs, most, left = ledger(spark, slices, "40 minutes", 3600)
    assert most > 20 and left == 0 and {x[3] for x in runs} == {"retry", "end", "commit", "expired"}
    for n in (1, 4):
        got, most, left = ledger(spark, slices, "40 minutes", 3600, shards=n)
        assert got == runs and 0 < most <= n and left == 0


def test_query_holds_fewer_states_than_runs(spark, monkeypatch):
    from issuelens import catalog
    from .conftest import SF_SMALL
    queries = []
    monkeypatch.setattr(catalog.XT, "run_to_parquet", lambda *a: queries.append(run_to_parquet(*a)) or queries[-1])
    got = catalog.QUERIES["x2_expiring_ledger"](spark, SF_SMALL)
    runs = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("user_id").distinct().count()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in queries[0].recentProgress if p["stateOperators"]]
    assert got.count() >= runs and 0 < max(states) <= runs / 3


# -- collected logs ----------------------------------------------------------

def test_collected_logs_give_the_records_of_single_ones(spark):
    import os
    from issuelens.streaming.log_tail import stream_run_log
    logs = {"a.log": LOG, "b c.log": "2024-01-02 03:04:05,678 [INFO] tab\there\n\tno header\n2024-01-02 03:04:05,678 [INFO]  x\n",
            "d": "only\n\n"}
    single, collected = scratch_path(spark, "single"), scratch_path(spark, "collected")
    for folder in (single, collected):
        os.makedirs(folder.removeprefix("file:"))
    with open(f"{collected.removeprefix('file:')}/all", "w", newline="") as every:
        for name, text in logs.items():
            with open(f"{single.removeprefix('file:')}/{name}", "w", newline="") as f:
                f.write(text)
            every.writelines(f"{name}\t{line}\n" for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"))
        every.write("2024-01-02 03:04:05,678 [INFO] without a name\n")
    found = []
    for path, named in ((f"{single}*", False), (f"{collected}*", True), (f"{collected}-none*", True)):
        out, ckpt = scratch_path(spark, "out"), scratch_path(spark, "ckpt")
        s = stream_run_log(spark, path, named=named)
        run_to_parquet(s, out, ckpt).awaitTermination()
        got = spark.read.schema(s.schema).parquet(out).collect() if os.path.isdir(out.removeprefix("file:")) else []
        found.append(sorted(((x.source_path.rsplit("/", 1)[-1].replace("%20", " "), *tuple(x)[1:]) for x in got), key=key))
    assert len(found[0]) == 6 and found[1] == found[0] and found[2] == []


def test_runs_are_not_a_folder_each(spark, monkeypatch):
    from .conftest import SF_SMALL
    from .test_sources_and_plans import written
    df, files = written(monkeypatch, "x1_stream_run_log", spark, SF_SMALL, "logs-in")
    runs = {r[0] for r in spark.read.parquet(f"{SF_SMALL}/events.parquet").select("user_id").distinct().collect()}
    assert {r[0] for r in df.select("source_file").distinct().collect()} == {f"run_{u}.log" for u in runs}
    assert len(files) <= 8 < len(runs) and any("form=collected" in str(f) for f in files)
