"""Sources and sinks on our own small files, stream = batch, and checks on
the physical plans the optimizer picks."""

import json
import re

from pyspark.sql import functions as F

from issuelens.catalog import QUERIES
from issuelens.operators import runs as W
from issuelens.sources import logs as L
from issuelens.sources.issues import read_issues
from issuelens.sources.repo_files import apply_updates, read_repo_files, write_snapshot
from issuelens.operators.benchmark import write_results

from .conftest import SF_SMALL

ISSUES = {
    "bug.md": "### Fix discount\n\n**File:** `prices.py`  \n1. Crash when price is 0\n",
    "feature.md": "### Add conversion\n\nSupport kelvin.\n",
    "refactor.md": "Move helpers from `a.py`, `b.py` and `c.py` into `util/dates.py`.\n",
    "tests.md": "Write unit tests for `checks.py`: valid, invalid and edge inputs.\n",
}


def test_read_issues_whole_files(spark, tmp_path):
    for name, text in ISSUES.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    (tmp_path / "notes.txt").write_text("ignored", encoding="utf-8")
    got = {r.issue_file.rsplit("/", 1)[-1]: r.body for r in read_issues(spark, str(tmp_path), "*.md").collect()}
    assert got == ISSUES


def test_read_repo_files_walk(spark, tmp_path):
    root = tmp_path / "proj"
    for rel, body in {"a.py": "x", "tests/test_a.py": "t", "web/app.tsx": "w", "README.md": "r",
                      "cfg.json": "{}", "deep/er/m.JS": "no"}.items():
        p = root / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body, encoding="utf-8")
    df = read_repo_files(spark, str(root))
    got = sorted((r.repo, r.path, r.content) for r in df.collect())
    assert got == [("proj", "a.py", "x"), ("proj", "cfg.json", "{}"), ("proj", "tests/test_a.py", "t"),
                   ("proj", "web/app.tsx", "w")]


def _log_text(n_records):
    lines = []
    for i in range(n_records):
        lines.append(f"2025-01-02 03:04:{i % 60:02d},{i % 1000:03d} [{['INFO', 'ERROR', 'WARNING'][i % 3]}] "
                     f"msg {i}")
        for k in range(i % 4):
            lines.append(f"  continuation {i}.{k}")
    return "\n".join(lines) + "\n"


def _py_records(text):
    head = re.compile(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3} \[([A-Z]+)\] (.*)$")
    recs = []
    for line in text.splitlines():
        m = head.match(line)
        if m:
            recs.append([m.group(1), m.group(2)])
        else:
            recs[-1][1] += "\n" + line
    return [tuple(r) for r in recs]


def test_read_run_logs_across_splits(spark, tmp_path):
    text = "orphan line before any header\n" + _log_text(3000)
    (tmp_path / "run.log").write_text(text, encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = L.read_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        nums = sorted(r.line_no for r in lines.select("line_no").collect())
        assert nums == list(range(1, len(text.splitlines()) + 1))
        recs = L.parse_log_lines(lines, bucket=64).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert recs[0].level is None and recs[0].message == "orphan line before any header"
    assert [(r.level, r.message) for r in recs[1:]] == _py_records(text.split("\n", 1)[1])
    prof = W.trace_profile(L.parse_log_lines(L.read_lines(spark, str(tmp_path))).filter("level is not null"),
                           key="source_file").first()
    assert (prof.n_records, prof.n_info, prof.n_error, prof.n_warning) == (3000, 1000, 1000, 1000)


def test_final_states_and_report(spark, tmp_path):
    state = {"github_issue": "x", "plan": {"relevant_files": ["a.py"], "source_files": ["a.py"], "test_files": [],
                                          "is_test_generation_issue": False},
             "test_results": {"test_outputs": {"t.py": "[Exit code: 0]"}, "tests_passed": True},
             "passed": True, "unknown_key": 1}
    msgs = [L.FINAL_STATE_PREFIX + "\n" + json.dumps(state, indent=2),
            L.FINAL_STATE_PREFIX + " {'github_issue': 'x', 'passed': True}",
            "Workflow completed successfully!"]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(msgs)], "id long, message string")
    st = {r.id: r for r in L.final_states(df).collect()}
    assert set(st) == {0, 1}
    assert st[0].state.passed is True and st[0].state.lint_results is None and st[0].corrupt_state is None
    assert st[0].state.test_results.test_outputs == {"t.py": "[Exit code: 0]"}
    assert st[1].state is None and "github_issue" in st[1].corrupt_state
    states = L.final_states(df).filter("state is not null").select("state.*")
    L.write_state_report(states, str(tmp_path / "spark"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "spark").glob("part-*"))
    assert '"last_errors" : null' in text and '"passed" : true' in text
    want = {k: state.get(k) for k in [f.name for f in L.STATE_SCHEMA.fields]}
    want["lint_results"] = want["code_changes"] = None
    assert json.loads(text) == want


def test_apply_updates_and_snapshot(spark, tmp_path):
    snap = spark.createDataFrame([("r", "a.py", "old\n"), ("r", "b.py", "keep\n")], "repo string, path string, content string")
    upd = spark.createDataFrame([("r", "a.py", 1, "```python\nnew  \n```"), ("r", "a.py", 2, "newer\n\n"),
                                 ("r", "c.py", 1, "created"), ("r", "b.py", 3, "```\n```")],
                                "repo string, path string, seq long, response string")
    got = {r.path: (r.content, r.status) for r in apply_updates(snap, upd).collect()}
    assert got == {"a.py": ("newer\n", "updated"), "b.py": ("keep\n", "unchanged"), "c.py": ("created\n", "created")}
    write_snapshot(apply_updates(snap, upd), str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 3


def test_write_results_partitioned(spark, tmp_path):
    res = spark.createDataFrame([("o/r", "i1", True), ("o/s", "i2", False)], "repo string, instance_id string, tests_passed boolean")
    write_results(res, str(tmp_path / "res"))
    assert sorted(p.name for p in (tmp_path / "res").iterdir() if p.is_dir()) == ["repo=o%2Fr", "repo=o%2Fs"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_match_tests_is_an_equi_join(spark):
    p = plan_of(QUERIES["j1_match_tests"](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "HashJoin" in p or "SortMergeJoin" in p


def test_flagship_prunes_columns(spark):
    df = QUERIES["a1_candidate_files"](spark, SF_SMALL)
    scans = [m for m in re.findall(r"ReadSchema: (struct<[^>]*>)", df._jdf.queryExecution().executedPlan()
                                   .toString())]
    text = plan_of(df)
    assert "p_type" not in text and "p_size" not in text          # file content never read
    assert "lang" not in " ".join(scans) and "n_chars" not in text


def test_ledger_limits_rows_per_run_before_the_window(spark):
    assert "WindowGroupLimit" in plan_of(QUERIES["w1_retry_ledger"](spark, SF_SMALL))


def test_stream_equals_batch(spark):
    s = QUERIES["x2_stream_retry_ledger"](spark, SF_SMALL).collect()
    b = {tuple(r) for r in QUERIES["w1_retry_ledger"](spark, SF_SMALL).select(
        "run_id", "event_id", "attempt", "decision").collect()}
    assert {tuple(r)[:4] for r in s} == b
    c = {tuple(r) for r in QUERIES["w3_carry_errors"](spark, SF_SMALL).select("run_id", "event_id", "carried_errors").collect()}
    assert {(r.run_id, r.event_id, r.carried_errors) for r in s} == c
    assert QUERIES["x1_stream_run_log"](spark, SF_SMALL).count() == spark.read.parquet(
        f"{SF_SMALL}/events.parquet").count()


def test_time_queries_do_not_depend_on_session_zone(spark):
    keys = ["s5_run_logs", "w4_run_spans", "a9_benchmark_summary"]
    base = {k: sorted(map(tuple, QUERIES[k](spark, SF_SMALL).collect())) for k in keys}
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for k in keys:
            assert sorted(map(tuple, QUERIES[k](spark, SF_SMALL).collect())) == base[k], k
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def _phase(name):
    return "=" * 20 + f" starting {name} phase " + "=" * 20


def test_trace_profile_golden_shape(spark, tmp_path):
    """A run shaped like the failed bug-fix run of BASELINE (98 records:
    94 INFO / 0 WARNING / 4 ERROR, 4 check phases, 4 code-generation
    phases, 3 retries) written as our own log text."""
    recs = [("INFO", _phase(p)) for p in ("run_workflow", "initialize_issue_repo", "retrieve_issue_details",
                                         "planning")]
    for attempt in range(4):
        recs += [("INFO", _phase("code_generation")), ("INFO", "agent_respond() – call"),
                 ("INFO", _phase("test_and_lint")),
                 ("ERROR", "test_and_lint() – Test failed for tests/test_x.py:\nSTDOUT:\nF\n1 failed in 0.1s\nSTDERR:\n")]
        recs.append(("INFO", f"Tests did not pass. Retrying code_generation (attempt {attempt + 1}/3)."
                     if attempt < 3 else "Tests did not pass and retry limit reached. Not retrying. :("))
    while len(recs) < 98:
        recs.insert(5, ("INFO", f"detail {len(recs)}"))
    text = "".join(f"2025-01-02 03:04:{i % 60:02d},{i:03d} [{lv}] {msg}\n" for i, (lv, msg) in enumerate(recs))
    (tmp_path / "run.log").write_text(text, encoding="utf-8")
    p = W.trace_profile(L.read_run_logs(spark, str(tmp_path)), key="source_file").first()
    assert (p.n_records, p.n_info, p.n_warning, p.n_error) == (98, 94, 0, 4)
    assert (p.n_check_phases, p.n_code_phases, p.n_test_gen_phases, p.n_retries) == (4, 4, 0, 3)


def test_stem_index_holds_only_what_is_asked_for(spark):
    """Index rows per test file, before and after: all substrings, those of the
    lengths that occur, those that pass the filter of the stems."""
    from pyspark.sql import functions as F
    from issuelens.catalog import inventory
    from issuelens.operators import retrieval as R
    from issuelens.sources import tables as T
    inv = inventory(spark, SF_SMALL)
    stems = R._keyed(R.mentions(T.v_issues(spark, SF_SMALL))).select("repo", "key")
    every, asked = R.test_index(inv), R.test_index(inv, stems)
    n_files = inv.filter(R.is_test_name("path")).count()
    before, after = every.count() / n_files, asked.count() / n_files
    assert before > 100 and after < before / 20, (before, after)
    wanted = lambda x: sorted(tuple(r) for r in x.join(stems.distinct(), ["repo", "key"]).collect())
    assert wanted(every) == wanted(asked)
    bits = R.stem_filter(stems).select(F.sum(F.bitmap_count("_bits"))).first()[0]
    assert 0 < bits <= stems.distinct().count()


def test_candidates_scan_the_bodies_once(spark):
    plan = plan_of(QUERIES["a1_candidate_files"](spark, SF_SMALL))
    assert "documents" not in plan and "Scan ExistingRDD" in plan  # the mention rows were written by one job


def test_issue_without_body_falls_back(spark):
    from issuelens.operators import retrieval as R
    issues = spark.createDataFrame([(1, "r", None), (2, "r", "no file"), (3, "r", "see `b.py`"), (4, "other", None)],
                                   "issue_id long, repo string, body string")
    inv = spark.createDataFrame([("r", "a.py"), ("r", "tests/test_b.py")], "repo string, path string")
    got = sorted((x.issue_id, x.path) for x in R.candidate_files(issues, inv).collect())
    assert got == [(1, "a.py"), (1, "tests/test_b.py"), (2, "a.py"), (2, "tests/test_b.py"), (3, "b.py"), (3, "tests/test_b.py")]


def test_runs_are_split_by_load(spark):
    """One run holds half of the rows, all inside one second; some share the
    time, and some rows have none."""
    import datetime as dt
    import random
    from pyspark.sql import functions as F
    from issuelens.operators import runs as W
    r = random.Random(5)
    t0 = dt.datetime(2024, 5, 1)
    rows = [(7, i, t0 + dt.timedelta(microseconds=r.randint(0, 999_999) if i % 3 else 500_000)) for i in range(6000)]
    rows += [(r.randint(0, 300), 10_000 + i, t0 + dt.timedelta(seconds=r.randint(0, 10**6))) for i in range(6000)]
    rows += [(7, 20_000 + i, None) for i in range(50)] + [(None, 30_000 + i, t0) for i in range(50)]
    df = spark.createDataFrame(rows, "run_id long, event_id long, ts timestamp_ntz")
    parts = W._bucketed(df, "run_id", ("ts", "event_id"), 50)
    sizes = [x["count"] for x in parts.groupBy("run_id", "_b").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 12 * 50
    us = W._micros(df, "ts")
    got = W.next_in_run(df, us, rows=50).select("event_id", "_next").collect()
    plain = df.withColumn("_next", F.lead(us).over(W.Window.partitionBy("run_id").orderBy("ts", "event_id"))).select("event_id", "_next")
    assert len(got) == len(rows) and {tuple(x) for x in got} == {tuple(x) for x in plain.collect()}
    cuts = W.run_cuts(df, "run_id", ("ts", "event_id"), 2, most=16).collect()
    assert max(len(x._cuts) for x in cuts) <= 16 and all(x._cuts == sorted(x._cuts, key=lambda c: (c.ts is not None, c.ts or t0, c.event_id)) for x in cuts)


def test_spread_deals_small_scans_of_few_row_groups_only(spark, tmp_path):
    from issuelens.sources.tables import spread
    path = str(tmp_path / "one_group")
    spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    few = spread(df, task_mb=1.0)
    assert few.rdd.getNumPartitions() > df.rdd.getNumPartitions()
    assert few.agg(F.count("*"), F.sum("id")).first() == df.agg(F.count("*"), F.sum("id")).first()
    assert spread(df, task_mb=1.0, total_mb=2.0) is df
    assert spread(df, task_mb=1000.0) is df
    plan = few.filter("id > 5").select("id")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<id:bigint>" in plan and "GreaterThan(id,5)" in plan


def test_packed_issues_come_back_whole(spark):
    from issuelens.session import scratch_path
    from issuelens.sources.issues import write_packed_issues
    bodies = ["", "a\x1eb\x1e", "\x10P\x10R\x10B \x10\x1e\x10", "\ufeffline\r\nline\r\n\n", "\x00é漢\U0001F600", "\x1e", "R\x10", *ISSUES.values()]
    out = scratch_path(spark, "packs")
    rows = spark.createDataFrame([(b,) for b in bodies * 50], "body string").repartition(3)
    write_packed_issues(rows, out)
    # Small splits, so that bodies lie over two of them.
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    try:
        got = read_issues(spark, out, packed=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(r.body for r in got) == sorted(bodies * 50)
    assert len({r.issue_file for r in got}) == 3


def written(monkeypatch, query, spark, sf_dir, name):
    """The result of a query and the data files it wrote to its scratch folders of that name."""
    from pathlib import Path
    import issuelens.session as S
    given, made = S.scratch_path, []

    def scratch_path(spark, n):
        made.append((n, given(spark, n)))
        return made[-1][1]
    monkeypatch.setattr(S, "scratch_path", scratch_path)
    result = QUERIES[query](spark, sf_dir)
    found = [f for n, p in made if n.startswith(name) for f in Path(p.removeprefix("file:")).rglob("part-*")]
    return result, found


def test_issues_are_not_a_file_each(spark, monkeypatch):
    df, files = written(monkeypatch, "s1_read_issues", spark, SF_SMALL, "issue-")
    n = spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    assert df.count() == n and len(files) < n / 4
