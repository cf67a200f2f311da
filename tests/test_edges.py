"""Hand-written edge tables (one per listed case) for the operators."""

import datetime as dt
import re

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from issuelens.functions.paths import file_name, file_stem, file_suffix
from issuelens.functions.text import py_int, py_split_count, py_strip
from issuelens.operators import outcomes as O
from issuelens.operators import planning as P
from issuelens.operators import quality as Q
from issuelens.operators import repos as RP
from issuelens.operators import retrieval as R
from issuelens.operators import runs as W
from issuelens.operators import textops as X
from issuelens.sources import logs as L
from issuelens.sources import tables as T
from issuelens.sources.issues import resolve_issue_refs

from .conftest import SF_SMALL


def col_values(df, c):
    return [r[c] for r in df.collect()]


def test_mentions_quirks(spark):
    cases = [
        ("see a/b.json here", ["a/b.js"]),
        ("app.tsx", ["app.ts"]),
        ("x.pyc", ["x.py"]),
        ("docs at pandas.pydata.org", ["pandas.py"]),
        ("src\\m.py", ["src/m.py"]),
        (".py alone", []),
        ("a.b.py..js", ["b.py"]),
        ("", []),
        ("two x.py and x.py", ["x.py"]),
    ]
    df = spark.createDataFrame([(i, "r", t) for i, (t, _) in enumerate(cases)], "issue_id long, repo string, body string")
    got = {}
    for r in R.mentions(df).collect():
        got.setdefault(r.issue_id, []).append(r.path)
    for i, (_, want) in enumerate(cases):
        assert sorted(got.get(i, [])) == sorted(want), cases[i]


def test_path_parts(spark):
    df = spark.createDataFrame([("a/b/c.tar.gz",), (".py",), ("x",), ("d/.hidden",), ("t/test_x.py",)], "p string")
    rows = df.select(file_name("p").alias("n"), file_suffix("p").alias("s"), file_stem("p").alias("t")).collect()
    assert [tuple(r) for r in rows] == [("c.tar.gz", ".gz", "c.tar"), (".py", "", ".py"), ("x", "", "x"),
                                        (".hidden", "", ".hidden"), ("test_x.py", ".py", "test_x")]


def test_test_flag_uses_name_only(spark):
    df = spark.createDataFrame([("spectrum.py",), ("latest.py",), ("tests/util.py",), ("a/Spec_b.ts",)], "path string")
    assert col_values(R.with_test_flag(df), "is_test") == [True, True, False, True]


def test_match_tests_contains_stem(spark):
    inv = spark.createDataFrame(
        [("r", "tests/test_price_utils.py"), ("r", "tests/test_other.py"), ("r", "price_utils.py"),
         ("q", "tests/test_price_utils.py"), ("r", "spec/PriceUtilsSpec.js")], "repo string, path string")
    m = spark.createDataFrame([(1, "r", "price_utils.py"), (2, "r", "PriceUtils.js"), (3, "r", "x/.py")],
                              "issue_id long, repo string, path string")
    got = sorted((r.issue_id, r.path) for r in R.match_tests(m, inv).collect())
    assert got == [(1, "tests/test_price_utils.py"), (2, "spec/PriceUtilsSpec.js")]


def test_candidate_fallback_all_files(spark):
    inv = spark.createDataFrame([("r", "a.py"), ("r", "tests/test_a.py"), ("s", "b.py")], "repo string, path string")
    issues = spark.createDataFrame([(1, "r", "fix a.py"), (2, "r", "no file named"), (3, "s", "")],
                                   "issue_id long, repo string, body string")
    c = R.candidate_lists(R.candidate_files(issues, inv)).collect()
    got = {r.issue_id: r.candidates for r in c}
    assert got[1] == ["a.py", "tests/test_a.py"]
    assert got[2] == ["a.py", "tests/test_a.py"]
    assert got[3] == ["b.py"]


def test_repo_key_variants(spark):
    urls = ["https://github.com/o/r.git", "https://github.com/o/r", "git@github.com:o/r.git", "o/r",
            "https://github.com/o/r/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    rows = df.select(RP.repo_key(F.col("url")).alias("k"), RP.repo_dir_name(F.col("url")).alias("d")).collect()
    assert [r.k for r in rows] == ["o/r", "o/r", "o/r", None, "r/"]
    assert [r.d for r in rows] == ["r", "r", "r", "r", "r"]


def test_int_parse_like_python(spark):
    vals = ["12", " 12 ", "+5", "1_000", "0", "-3", "1.0", "0x1", "1__0", "", "  "]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = col_values(df.select(py_int("v").alias("n")), "n")

    def pyint(s):
        try:
            return int(s)
        except ValueError:
            return None
    assert got == [pyint(v) for v in vals]


def test_resolve_refs(spark):
    issues = spark.createDataFrame([("r", 12, "# T\n**bold** `x.py`", "open"), ("r", 5, "", "open"),
                                    ("r", 7, "body", "closed")], "repo string, number long, body string, state string")
    refs = spark.createDataFrame([(1, "r", "12"), (2, "r", " 12 "), (3, "r", "+5"), (4, "r", "0"), (5, "r", "-3"),
                                  (6, "r", "1.0"), (7, "r", "   "), (8, "r", "7"), (9, "r", "99"), (10, "r", "f.md")],
                                 "ref_id long, repo string, ref string")
    files = spark.createDataFrame([("f.md", "issue from a file")], "path string, content string")
    got = {r.ref_id: (r.kind, r.body, r.reason) for r in resolve_issue_refs(refs, issues, files).collect()}
    assert got[1] == ("number", "T\nbold x.py", None)
    assert got[2][0] == "number"
    assert got[3] == ("rejected", None, "issue 5: empty body")
    assert got[4][0] == got[5][0] == "rejected"
    assert got[6] == ("text", "1.0", None)
    assert got[7] == ("rejected", None, "empty reference")
    assert got[8] == ("rejected", None, "issue 7: state is not open")
    assert got[9] == ("rejected", None, "issue 99: unknown")
    assert got[10] == ("file", "issue from a file", None)


def py_clean(raw):
    return re.sub(r"^```[a-zA-Z]*\s*|```$", "", raw.strip(), flags=re.MULTILINE).strip()


def test_clean_response(spark):
    cases = ["```python\nx = 1\n```", "```\ny\n```", "a ```b``` c", "```c++\nz\n```", "plain",
             "  \n```js\nq\n```\n ", "```\r\nw\r\n```", "x\x85```\n\u2028y```"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert col_values(df.select(X.clean_response("t").alias("c")), "c") == [py_clean(c) for c in cases]


def test_diff_gate_and_tokens(spark):
    df = spark.createDataFrame([("  diff --git a b",), ("nope diff ",), ("a b c  d\x1ce",)], "t string")
    r = df.select(X.diff_only("t").alias("d"), py_split_count("t").alias("n"), py_strip("t").alias("s")).collect()
    assert [x.d for x in r] == ["  diff --git a b", "", ""]
    assert [x.n for x in r] == [len(x.split()) for x in ["  diff --git a b", "nope diff ", "a b c  d\x1ce"]]


def test_parse_plans_cases(spark):
    rows = [(0, '{"relevant_files": ["a"], "source_files": ["a"], "test_files": ["t"], "is_test_generation_issue": true}'),
            (1, '{"source_files": ["a"]}'), (2, ""), (3, "not json"), (4, '{"relevant_files": "a"}'), (5, None)]
    df = spark.createDataFrame([(i, r, ["c1", "c2"]) for i, r in rows], "id long, response string, candidates array<string>")
    got = {r.id: r for r in P.parse_plans(df).collect()}
    assert got[0].parsed_ok and got[0].test_files == ["t"] and got[0].is_test_generation_issue
    assert got[1].parsed_ok and got[1].relevant_files == [] and got[1].source_files == ["a"]
    for i in (2, 3, 4, 5):
        assert not got[i].parsed_ok
        assert got[i].relevant_files == got[i].source_files == ["c1", "c2"] and got[i].test_files == []


def test_infer_test_files(spark):
    df = spark.createDataFrame([(1, "python", ["src/test_x.py"]), (2, "python", []), (3, "typescript", ["a/b.ts"]),
                                (4, "javascript", []), (5, "javascript", ["m.js"])],
                               "run_id long, language string, source_files array<string>")
    got = [r.test_files[0] for r in P.infer_test_files(df.withColumn("test_files", F.array())).orderBy("run_id").collect()]
    assert got == ["test_x.py", "test_generated.py", "b.test.ts", "generated.test.ts", "m.test.js"]


def test_language_detection(spark):
    df = spark.createDataFrame([("Python", []), ("TypeScript", []), ("pandas tests", []), ("node js", []),
                                (None, ["README.md", "x.JSX"]), ("Go", ["a.md"]), ("Rust", ["y.tsx"])],
                               "ctx string, files array<string>")
    got = col_values(df.select(P.language_of(F.col("ctx"), F.col("files")).alias("l")), "l")
    assert got == ["python", "typescript", "typescript", "javascript", "javascript", "python", "typescript"]


def checks_df(spark, rows):
    return spark.createDataFrame(rows, "run_id long, seq long, kind string, file string, exit_code int, "
                                       "stdout string, stderr string, error string")


def test_verdict_table(spark):
    rows = [
        (1, 1, "lint", "a.py", 1, "", "E1", None),                     # all tests skipped → rule 4
        (2, 1, "test", "t_test.py", 1, "no tests ran in 0.1s", "", None),  # rule 3
        (2, 2, "lint", "a.py", 1, "", "", None),
        (3, 1, "test", "t_test.py", 0, "1 passed", "", None),            # rule 4, lint fails
        (3, 2, "lint", "a.py", 2, "", "", None),
        (4, 1, "test", "t_test.py", None, None, None, "boom"),          # exception
        (5, 1, "test", "t_test.py", 0, "ok", "", None),
        (5, 2, "test", "t_test.py", 1, "FAILED", "err", None),          # same file twice: last output wins
    ]
    v = {r.run_id: r for r in O.run_verdict(checks_df(spark, rows)).collect()}
    assert (v[1].rule, v[1].tests_passed, v[1].lint_passed, v[1].passed) == (4, True, False, False)
    assert v[1].last_errors == "Lint failure in a.py: Exit code 1"
    assert (v[2].rule, v[2].tests_passed, v[2].lint_passed, v[2].passed, v[2].last_errors) == (3, True, False, True, None)
    assert (v[3].rule, v[3].tests_passed, v[3].lint_passed, v[3].passed) == (4, True, False, False)
    assert v[3].last_errors == "Lint failure in a.py: Exit code 2"
    assert (v[4].tests_passed, v[4].passed, v[4].last_errors) == (False, False, "Test error in t_test.py: boom")
    assert v[5].tests_passed is False
    assert v[5].last_errors == "Test failure in t_test.py:\nFAILED\nerr"
    outs = {r.run_id: r.test_outputs for r in O.outputs_by_run(checks_df(spark, rows)).collect()}
    assert outs[5]["t_test.py"].startswith("[Exit code: 1]")


def test_verdict_without_relevant_files(spark):
    plans = spark.createDataFrame([(9, [])], "run_id long, relevant_files array<string>")
    v = O.run_verdict(checks_df(spark, [(1, 1, "test", "t.py", 0, "", "", None)]), plans).collect()
    assert [(r.run_id, r.rule, r.passed) for r in v] == [(9, 1, None)]
    # Relevant files but no check of either kind: row 2.
    plans = spark.createDataFrame([(9, ["a.py"])], "run_id long, relevant_files array<string>")
    v = O.run_verdict(checks_df(spark, [(1, 1, "test", "t.py", 0, "", "", None)]), plans).collect()
    assert [(r.rule, r.tests_passed, r.lint_passed, r.passed) for r in v] == [(2, True, True, None)]


def attempts_df(spark, rows):
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(r, a, e, base + dt.timedelta(minutes=e), tp, None if tp else f"err{e}")
                                  for r, a, e, tp in rows],
                                 "run_id long, agent_id long, event_id long, ts timestamp, tests_passed boolean, errors string")


def test_retry_ledger_cases(spark):
    rows = [(1, 0, 1, True),                                                   # pass at once
            (2, 0, 2, False), (2, 0, 3, False), (2, 0, 4, False), (2, 0, 5, False), (2, 0, 6, False),  # fail ×5
            (3, 0, 7, False), (3, 0, 8, True), (3, 0, 9, False),              # fail, pass, (dropped)
            (4, 0, 10, None), (4, 0, 11, True)]                               # not applicable, then dropped
    led = W.retry_ledger(attempts_df(spark, rows))
    got = sorted((r.run_id, r.attempt, r.decision) for r in led.collect())
    assert got == [(1, 0, "commit"), (2, 0, "retry"), (2, 1, "retry"), (2, 2, "retry"), (2, 3, "end"),
                   (3, 0, "retry"), (3, 1, "commit"), (4, 0, "end")]
    no_commit = W.retry_ledger(attempts_df(spark, rows), commit=False)
    assert {r.decision for r in no_commit.filter("run_id = 1").collect()} == {"end"}
    carried = {(r.run_id, r.attempt): r.carried_errors for r in W.carry_errors(led).collect()}
    assert carried[(2, 1)] == "err2" and carried[(3, 1)] == "err7" and carried[(2, 0)] is None


def test_shared_budget(spark):
    rows = [(1, 7, 1, False), (1, 7, 2, False), (1, 7, 3, True),      # uses 2 retries
            (2, 7, 4, False), (2, 7, 5, False), (2, 7, 6, True),      # 1 left: retry then end
            (3, 7, 7, False)]                                          # none left: end
    led = W.retry_ledger(attempts_df(spark, rows), budget_scope="agent")
    got = sorted((r.run_id, r.attempt, r.decision) for r in led.collect())
    assert got == [(1, 0, "retry"), (1, 1, "retry"), (1, 2, "commit"), (2, 0, "retry"), (2, 1, "end"), (3, 0, "end")]


def test_sample_project_expectations(spark):
    df = spark.createDataFrame([(100.0, 20.0, 0.0, 32.0, "a@example.com"), (0.0, 10.0, 100.0, 212.0, ""),
                                (50.0, -5.0, -40.0, -40.0, None), (10.0, 150.0, -273.15, -459.67, "@example.com")],
                               "p double, d double, c double, f double, e string")
    r = df.select(Q.reprice("p", "d").cast("double").alias("r"), Q.c_to_f("c").cast("double").alias("cf"),
                  Q.f_to_c("f").cast("double").alias("fc"), Q.email_valid("e").alias("v")).collect()
    assert [x.r for x in r] == [80.0, 0.0, 50.0, -5.0]
    assert [x.cf for x in r] == [32.0, 212.0, -40.0, -459.67]
    assert [x.fc for x in r] == [0.0, 100.0, -40.0, -273.15]
    assert [x.v for x in r] == [True, False, False, True]


def test_failure_classification(spark):
    err = "ModuleNotFoundError: No module named 'b'\nModuleNotFoundError: No module named 'a'\nNo module named 'b'"
    df = spark.createDataFrame([("t.py", err), ("t.js", err), ("t.py", "ImportError: run pip install -e . please")],
                               "file string, stderr string")
    r = X.classify_failures(df).collect()
    assert [x.missing_modules for x in r] == [["a", "b"], [], []]
    assert [x.needs_build for x in r] == [False, False, True]


def test_normalize_test_paths(spark):
    plans = spark.createDataFrame([(1, "r", ["test_a.py", "tests/b.py"]), (2, "s", ["x.test.ts"]), (3, "u", ["y.py"])],
                                  "run_id long, repo string, test_files array<string>")
    files = spark.createDataFrame([("r", "tests/test_old.py"), ("s", "test/q.js"), ("u", "src/z.py")],
                                  "repo string, path string")
    got = {r.run_id: r.test_files for r in P.normalize_test_paths(plans, files).collect()}
    assert got == {1: ["tests/test_a.py", "tests/b.py"], 2: ["test/x.test.ts"], 3: ["tests/y.py"]}


def test_next_in_run_spans_partitions(spark):
    import random
    rnd = random.Random(7)
    rows = []
    eid = 0
    for run, n in [(1, 500), (2, 3), (3, 1), (4, 200)]:      # run 1 is hot
        t = 0
        for _ in range(n):
            t += rnd.randint(0, 3)
            rows.append((run, eid, t))
            eid += 1
    df = spark.createDataFrame(rows, "run_id long, event_id long, t long")
    df = df.withColumn("note", F.concat(F.lit("x"), F.col("event_id").cast("string")))
    got = {r.event_id: r._next for r in W.next_in_run(df, F.col("t"), order=("t", "event_id"), buckets=13).collect()}
    want = {}
    by_run = {}
    for r in rows:
        by_run.setdefault(r[0], []).append(r)
    for run, rs in by_run.items():
        rs = sorted(rs, key=lambda r: (r[2], r[1]))
        for a, b in zip(rs, rs[1:] + [None]):
            want[a[1]] = None if b is None else b[2]
    assert got == want


@pytest.mark.parametrize("buckets", [1, 8, 200])
def test_next_in_run_equals_the_window_whatever_the_plan(spark, buckets):
    """All columns kept, exchange reuse off, several bucket counts."""
    records = T.v_log_records(spark, SF_SMALL)
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        plain = records.withColumn("_next", F.lead("message").over(Window.partitionBy("run_id").orderBy("ts", "event_id")))
        got = W.next_in_run(records, F.col("message"), buckets=buckets).select(plain.columns)
        assert got.exceptAll(plain).count() == plain.exceptAll(got).count() == 0 < got.count()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_strict_json(spark):
    from issuelens.functions.json import strict_json
    good = ['{"a": 1}', ' [1, 2]\n', '"x"', "null", '{"a": "}],[{"}']
    bad = ["{'a': 1}", '{"a": 1} more', "{}],[{}", '{"a": 1}, {"b": 2}', "", "[1", "not json"]
    df = spark.createDataFrame([(x,) for x in good + bad], "s string").select("s", strict_json("s").alias("j"))
    assert {r.s: r.j for r in df.collect()} == {x: x for x in good} | {x: None for x in bad}


def test_markdown_keeps_code(spark):
    body = ("# Title\n\n**Bold** __it__ <b>x</b>  \nsee `__init__.py` and `a<b>c`\n```python\n# a comment\nf(**a, **b)  \n\n\n"
            "x = '<div>'\n```\n\n## Next\n```\nopen")
    df = spark.createDataFrame([(body,)], "body string")
    assert df.select(X.strip_markdown("body")).first()[0] == (
        "Title\nBold it x\nsee __init__.py and a<b>c\n```python\n# a comment\nf(**a, **b)  \n\n\nx = '<div>'\n```\nNext\n```\nopen")


def test_log_lines_without_header_and_with_an_impossible_date(spark):
    lines = ["first", "second", "2025-13-45 01:02:03,004 [INFO] odd", "more", "2025-01-02 01:02:03,004 [ERROR] x"]
    df = spark.createDataFrame([("f", i + 1, x) for i, x in enumerate(lines)], "source_file string, line_no long, line string")
    for bucket in (1, 2, 4096):
        got = [(r.line_no, r.ts is None, r.level, r.message) for r in L.parse_log_lines(df, bucket).orderBy("line_no").collect()]
        assert got == [(1, True, None, "first"), (2, True, None, "second"), (3, True, "INFO", "odd\nmore"), (5, False, "ERROR", "x")]


def test_python_string_semantics_randomized(spark):
    import random
    rnd = random.Random(11)
    alphabet = ["a", "b", "_", "1", "+", "-", " ", "\t", "\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "　",
                "é", "0"]
    vals = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 8))) for _ in range(400)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i long, v string")
    rows = df.select("i", py_split_count("v").alias("n"), py_strip("v").alias("s"), py_int("v").alias("k")) \
        .orderBy("i").collect()

    def pyint(s):
        try:
            return int(s) if s.strip().isascii() else None   # ours parses ASCII digits only
        except ValueError:
            return None
    for v, r in zip(vals, rows):
        assert r.n == len(v.split()), repr(v)
        assert r.s == v.strip(), repr(v)
        assert r.k == pyint(v), repr(v)


def test_class_variants(spark):
    rows = [(1, 1, "lint", "a.py", 1, "", "E1", None),
            (2, 1, "test", "t_test.py", 1, "no tests ran in 0.1s", "", None)]
    v = {r.run_id: (r.rule, r.tests_passed, r.passed) for r in
         O.run_verdict(checks_df(spark, rows), variant="class").collect()}
    assert v == {1: (4, True, False), 2: (4, False, False)}
    tests = spark.createDataFrame([(1, "r", "tests/test_a.py"), (1, "r", "web/a.test.ts"), (1, "r", "x.json")],
                                  "run_id long, repo string, path string")
    cfg = spark.createDataFrame([("r", "pyproject.toml", "[tool]\naddopts = --doctest-rst")],
                                "repo string, path string, content string")
    mod = sorted(r.command for r in P.check_worklist(tests, cfg).collect())
    cls = sorted(r.command for r in P.check_worklist(tests, cfg, variant="class").collect())
    assert mod == ["npm run test", "pytest"] and cls == ["npm run test", "pytest tests/test_a.py"]


def test_commit_paths(spark):
    vals = ["\\src\\a.py", "/b.py", "c/d.py", "//e\\\\f.py"]
    df = spark.createDataFrame([(v,) for v in vals], "p string")
    assert col_values(df.select(P.commit_path("p").alias("c")), "c") == [v.replace("\\", "/").lstrip("/") for v in vals]


def test_match_tests_randomized_against_nested_loop(spark):
    import random
    from pathlib import PurePosixPath
    rnd = random.Random(5)
    chars = "abcXY_-1.é"
    def word(n):
        return "".join(rnd.choice(chars) for _ in range(n))
    files = []
    for i in range(300):
        repo = "hot" if i % 3 else f"r{i % 4}"          # one repo holds two thirds of the files
        name = rnd.choice(["test_", "", "Spec", "x"]) + word(rnd.randint(1, 8)) + rnd.choice([".py", ".js", ".tsx"])
        files.append((repo, rnd.choice(["", "tests/", "a/b/"]) + name))
    files = sorted(set(files))
    stem_chars = "abcXY_-1"                              # what the mention pattern can capture
    mentions = sorted({(j, rnd.choice(["hot", "r0", "r1"]), rnd.choice(["", "src/"]) +
                        "".join(rnd.choice(stem_chars) for _ in range(rnd.randint(1, 5))) +
                        rnd.choice([".py", ".js"])) for j in range(200)})
    inv = spark.createDataFrame(files, "repo string, path string")
    m = spark.createDataFrame(mentions, "issue_id long, repo string, path string")
    got = sorted((r.issue_id, r.path) for r in R.match_tests(m, inv).collect())
    want = []
    for iid, repo, mp in mentions:
        base = PurePosixPath(mp).stem.lower()
        if not base:
            continue
        for frepo, fp in files:
            name = PurePosixPath(fp).name.lower()
            if frepo == repo and ("test" in name or "spec" in name) and base in name:
                want.append((iid, fp))
    assert got == sorted(want)


def test_candidate_files_randomized_against_python(spark):
    import random
    from pathlib import PurePosixPath
    rnd = random.Random(9)
    pieces = ["x.json", "a/b.tsx", "src\\m.py", "pandas.pydata.org", "Util-2.jsx", "word", "the", ".", " ",
              "\n", "`", "test_a.py", "z.pyc", "é.py", "a..js", "-_.ts", "x.json.py", "a.jsb.py", "ab.tsx.jsx",
              "../q.py", "m\\b.js.ts", ".py", "ts", "json"]
    files = sorted({(f"r{i % 3}", rnd.choice(["tests/test_", "spec/", "src/", ""]) +
                     rnd.choice(["m", "util-2", "b", "a", "x", "pandas", "q"]) + rnd.choice([".py", ".ts", ".js"]))
                    for i in range(60)})
    issues = [(i, f"r{i % 3}", "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 12)))) for i in range(400)]
    inv = spark.createDataFrame(files, "repo string, path string")
    df = spark.createDataFrame(issues, "issue_id long, repo string, body string")
    got = {r.issue_id: r.candidates for r in R.candidate_lists(R.candidate_files(df, inv)).collect()}
    pattern = re.compile(R.MENTION_PATTERN)
    for iid, repo, body in issues:
        mentioned = {m.replace("\\", "/") for m in pattern.findall(body)}
        repo_files = {p for r, p in files if r == repo}
        tests = set()
        for mf in mentioned:
            base = PurePosixPath(mf).stem.lower()
            for rf in repo_files:
                name = PurePosixPath(rf).name.lower()
                if ("test" in name or "spec" in name) and base and base in name:
                    tests.add(rf)
        want = sorted(mentioned | tests) or sorted(repo_files)
        assert got.get(iid, []) == want, (body, got.get(iid), want)


def test_strip_markdown_issue_shape(spark):
    md = ("### Fix rounding in the tax helper\n\n**File:** `tax_utils.py`  \n**Error Conditions:**\n"
          "1. Fails when rate is 0 (`ZeroDivisionError`)\n2. Wrong totals for negative rates\n\n"
          "**Expected Behavior:**\n- Return 0 for a zero rate\n- Treat negative rates as 0%\n\n"
          "```python\nx = 1\n```\n")
    want = ("Fix rounding in the tax helper\nFile: tax_utils.py\nError Conditions:\n"
            "1. Fails when rate is 0 (ZeroDivisionError)\n2. Wrong totals for negative rates\n"
            "Expected Behavior:\n- Return 0 for a zero rate\n- Treat negative rates as 0%\n```python\nx = 1\n```")
    df = spark.createDataFrame([(md,)], "t string")
    assert df.select(X.strip_markdown("t").alias("s")).first().s == want
