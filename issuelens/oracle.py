"""Independent DuckDB SQL for every registered query.

The derived views of :mod:`issuelens.sources.tables` are repeated here as
CTEs; each oracle query names the CTEs it needs and :func:`sql` puts them
(with their dependencies, in order) in front of the final SELECT.  The SQL is
written from the operator semantics, not from the Spark code: J1, for
instance, is a plain theta join here and a substring-index equi-join in
Spark.
"""

from __future__ import annotations

# Fixed values shared with the Spark side (see operators.retrieval).
MENTION_RE = r"[a-zA-Z0-9_\-/\\]+?\.(?:py|js|ts|tsx|jsx|json)"
NAME = "regexp_extract({p}, '([^/]*)$', 1)"
SUFFIX = "regexp_extract(regexp_extract({p}, '([^/]*)$', 1), '^.+(\\.[^.]+)$', 1)"
STEM = ("CASE WHEN " + SUFFIX + " = '' THEN " + NAME +
        " ELSE regexp_extract(" + NAME + ", '^(.+)\\.[^.]+$', 1) END")


def name_of(p: str) -> str:
    return NAME.format(p=p)


def suffix_of(p: str) -> str:
    return SUFFIX.format(p=p)


def stem_of(p: str) -> str:
    return STEM.format(p=p)


def repo_of(k: str) -> str:
    return f"concat('org', {k} % 5, '/repo', {k} % 25)"


CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, body: str, *deps: str) -> None:
    CTES[name] = (body, deps)


cte("v_repo_files", f"""
SELECT {repo_of('p_partkey')} AS repo, p_partkey AS file_id,
       CASE p_partkey % 4
         WHEN 0 THEN concat('src/', replace(p_name, ' ', '_'), '.py')
         WHEN 1 THEN concat('tests/test_', replace(p_name, ' ', '_'), '.py')
         WHEN 2 THEN concat('web/', replace(p_name, ' ', '_'), '.tsx')
         ELSE concat('docs/', replace(p_name, ' ', '_'), '.md') END AS path,
       concat('# ', p_type, chr(10), 'size = ', CAST(p_size AS VARCHAR), chr(10)) AS content
FROM part""")

cte("inventory", f"""
SELECT repo, path, min(content) AS content
FROM (SELECT repo, replace(path, '\\', '/') AS path, content FROM v_repo_files)
WHERE {suffix_of('path')} IN ('.py', '.js', '.ts', '.jsx', '.tsx', '.json')
GROUP BY repo, path""", "v_repo_files")

cte("v_repo_config", f"""
SELECT DISTINCT {repo_of('p_partkey')} AS repo, 'pyproject.toml' AS path,
       CASE WHEN (p_partkey % 25) % 3 = 0
            THEN '[tool.pytest.ini_options]' || chr(10) || 'addopts = "--doctest-rst"' || chr(10)
            ELSE '[project]' || chr(10) || 'name = "x"' || chr(10) END AS content
FROM part""")

cte("v_issues", f"""
SELECT d.doc_id AS issue_id, {repo_of('d.doc_id')} AS repo, d.doc_id AS number,
       '### Fix' || chr(10) || chr(10) || '**File:** ' ||
       CASE d.doc_id % 10 WHEN 3 THEN 'no file named'
         WHEN 5 THEN '`' || name || ext || '`, `src/' || name || '.py` and again `' || name || ext ||
                     '`; see `__init__.py` and <b>below</b>' || chr(10) ||
                     array_to_string(['```python', '# a comment', 'f(**a, **b)  ', 'x = ' || chr(39) || '<div>' || chr(39),
                                      '', '', 'y = __name__', '```'], chr(10))
         WHEN 7 THEN '`test.py`' ELSE '`' || name || ext || '`' END ||
       chr(10) || d.text AS body,
       CASE WHEN d.doc_id % 7 = 0 THEN 'closed' ELSE 'open' END AS state
FROM (SELECT d.*, coalesce(replace(p.p_name, ' ', '_'), 'unnamed') AS name,
             CASE d.doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.tsx' ELSE '.json' END AS ext
      FROM documents d LEFT JOIN part p ON p.p_partkey = d.doc_id) d""")

cte("v_attempts", """
SELECT user_id AS run_id, user_id % 10 AS agent_id, event_id, ts,
       CASE WHEN event_type = 'signup' AND event_id % 5 = 0 THEN NULL
            ELSE event_type = 'purchase' END AS tests_passed,
       CASE WHEN event_type <> 'purchase' THEN 'err ' || CAST(event_id AS VARCHAR) END AS errors
FROM events""")

cte("v_checks", """
SELECT l_orderkey AS run_id,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                          l_shipdate, l_extendedprice) AS seq,
       CASE WHEN l_linenumber % 2 = 0 THEN 'lint' ELSE 'test' END AS kind,
       'f' || CAST(l_linenumber AS VARCHAR) ||
         CASE WHEN l_linenumber % 2 = 0 THEN '.py' ELSE '_test.py' END AS file,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS exit_code,
       CASE WHEN l_linestatus = 'F' AND l_quantity > 45 THEN 'no tests ran in 0.01s'
            ELSE '1 passed in 0.1s' END AS stdout,
       CASE WHEN l_returnflag = 'R' THEN 'AssertionError: line ' || CAST(l_linenumber AS VARCHAR)
            ELSE '' END AS stderr,
       CASE WHEN l_quantity = 1 THEN 'timeout after ' || CAST(l_linenumber AS VARCHAR) || 's' END AS error
FROM lineitem""")

cte("v_calls", """
SELECT u.conv_id * 1000 + u.turn AS call_id, u.conv_id, u.turn, u.text AS prompt, a.text AS response
FROM conversations u JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'""")

# -- retrieval ---------------------------------------------------------------
cte("mentions", f"""
SELECT DISTINCT issue_id, repo, replace(m, '\\', '/') AS path
FROM (SELECT issue_id, repo, unnest(regexp_extract_all(body, '{MENTION_RE}')) AS m FROM v_issues)""",
    "v_issues")

cte("mention_keys", f"""
SELECT issue_id, repo, path AS mention, lower({stem_of('path')}) AS key FROM mentions""", "mentions")

cte("test_files", f"""
SELECT repo, path, lower({name_of('path')}) AS name_lc FROM inventory
WHERE contains(lower({name_of('path')}), 'test') OR contains(lower({name_of('path')}), 'spec')""",
    "inventory")

cte("matches", """
SELECT k.issue_id, k.repo, k.mention, t.path
FROM mention_keys k JOIN test_files t ON t.repo = k.repo AND contains(t.name_lc, k.key)
WHERE k.key <> ''""", "mention_keys", "test_files")

cte("candidates", """
SELECT issue_id, repo, path FROM mentions
UNION
SELECT issue_id, repo, path FROM matches""", "mentions", "matches")

cte("cand_all", """
SELECT issue_id, repo, path FROM candidates
UNION ALL
SELECT i.issue_id, i.repo, v.path FROM v_issues i JOIN inventory v ON v.repo = i.repo
WHERE NOT EXISTS (SELECT 1 FROM candidates c WHERE c.issue_id = i.issue_id)""",
    "candidates", "v_issues", "inventory")


def sql(body: str, *names: str) -> str:
    """Prefix ``body`` with the named CTEs and everything they depend on."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    body = body.strip()
    if not order:
        return body
    parts = [f"{n} AS ({CTES[n][0].strip()})" for n in order]
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


ORACLE: dict[str, str] = {}


def oracle(key: str, body: str, *names: str) -> None:
    ORACLE[key] = sql(body, *names)


oracle("a1_candidate_files", "SELECT issue_id, repo, path FROM cand_all", "cand_all")
oracle("f8_mentions", "SELECT issue_id, repo, path FROM mentions", "mentions")
oracle("s3_repo_inventory", "SELECT repo, path FROM inventory", "inventory")
oracle("f9_test_flag", f"""
SELECT repo, path, contains(lower({name_of('path')}), 'test') OR contains(lower({name_of('path')}), 'spec') AS is_test
FROM inventory""", "inventory")
oracle("j1_match_tests", "SELECT issue_id, repo, mention, path FROM matches", "matches")

# -- check outcomes ----------------------------------------------------------
OUTPUT_SQL = """CASE WHEN error IS NOT NULL
     THEN (CASE WHEN kind = 'test' THEN 'Test error: ' ELSE 'Lint error: ' END) || error
     ELSE '[Exit code: ' || CAST(exit_code AS VARCHAR) || ']' || chr(10) || 'STDOUT:' || chr(10) ||
          coalesce(stdout, '') || chr(10) || 'STDERR:' || chr(10) || coalesce(stderr, '') END"""

cte("checks_out", f"SELECT *, {OUTPUT_SQL} AS output FROM v_checks", "v_checks")
cte("checks_last", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, kind, file ORDER BY seq DESC) AS rn
               FROM checks_out) WHERE rn = 1""", "checks_out")

oracle("f23_check_outputs", """
SELECT run_id, seq, output,
       CASE WHEN error IS NULL THEN CAST(exit_code AS BIGINT) END AS parsed_exit_code,
       CASE WHEN error IS NULL THEN stdout END AS parsed_stdout,
       CASE WHEN error IS NULL THEN stderr END AS parsed_stderr,
       CAST(nullif(regexp_extract(output, '([0-9]+) failed', 1), '') AS BIGINT) AS n_failed,
       CAST(nullif(regexp_extract(output, '([0-9]+) passed', 1), '') AS BIGINT) AS n_passed,
       CAST(nullif(regexp_extract(output, ' in ([0-9]+(\\.[0-9]+)?)s', 1), '') AS DOUBLE) AS test_seconds
FROM checks_out""", "checks_out")

oracle("w5_latest_per_file", "SELECT run_id, kind, file, seq, exit_code FROM checks_last", "checks_last")
oracle("a3_outputs_by_run", "SELECT run_id, kind, file, output FROM checks_last", "checks_last")

FAILED_SQL = "(error IS NOT NULL OR coalesce(exit_code, 0) <> 0)"
FAILURE_TEXT_SQL = """CASE WHEN kind = 'test' AND error IS NOT NULL THEN 'Test error in ' || file || ': ' || error
     WHEN kind = 'test' THEN 'Test failure in ' || file || ':' || chr(10) || coalesce(stdout, '') || chr(10) ||
                             coalesce(stderr, '')
     WHEN error IS NOT NULL THEN 'Lint error in ' || file || ': ' || error
     ELSE 'Lint failure in ' || file || ': Exit code ' || CAST(exit_code AS VARCHAR) END"""

cte("digest", f"""
SELECT run_id,
       string_agg({FAILURE_TEXT_SQL}, chr(10) || chr(10)
                  ORDER BY CASE WHEN kind = 'test' THEN 0 ELSE 1 END, seq) FILTER (WHERE {FAILED_SQL})
         AS last_errors
FROM v_checks GROUP BY run_id""", "v_checks")

oracle("a6_error_digest", "SELECT run_id, last_errors FROM digest", "digest")
oracle("a6_error_pieces", f"""
SELECT run_id, row_number() OVER w - 1 AS piece,
       coalesce(sum(length(t) + 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", t AS text
FROM (SELECT run_id, seq, CASE WHEN kind = 'test' THEN 0 ELSE 1 END AS k, {FAILURE_TEXT_SQL} AS t FROM v_checks WHERE {FAILED_SQL})
WINDOW w AS (PARTITION BY run_id ORDER BY k, seq)""", "v_checks")

def verdict_sql(rule: str) -> str:
    return f"""
WITH plan AS (SELECT o_orderkey AS run_id, o_orderkey % 7 <> 0 AS has_rel FROM orders),
c AS (SELECT * FROM v_checks WHERE run_id % 11 <> 0),
per_run AS (
  SELECT run_id, count(*) AS n_checks,
         coalesce(bool_and(NOT {FAILED_SQL}) FILTER (WHERE kind = 'test'), true) AS tests_ok,
         coalesce(bool_and(NOT {FAILED_SQL}) FILTER (WHERE kind = 'lint'), true) AS lint_ok
  FROM c GROUP BY run_id),
ntr AS (SELECT run_id, bool_or(contains(lower(output), 'no tests ran')) AS no_tests_ran
        FROM checks_last WHERE kind = 'test' GROUP BY run_id),
j AS (SELECT plan.run_id, coalesce(tests_ok, true) AS tests_ok, coalesce(lint_ok, true) AS lint_ok,
             CASE WHEN n_checks IS NOT NULL THEN d.last_errors END AS last_errors, {rule} AS rule
      FROM plan LEFT JOIN per_run p USING (run_id) LEFT JOIN ntr n USING (run_id) LEFT JOIN digest d USING (run_id))
SELECT run_id, rule,
       CASE WHEN rule = 1 THEN NULL WHEN rule IN (2, 3) THEN true ELSE tests_ok END AS tests_passed,
       CASE WHEN rule = 1 THEN NULL WHEN rule = 2 THEN true ELSE lint_ok END AS lint_passed,
       CASE WHEN rule IN (1, 2) THEN NULL WHEN rule = 3 THEN true ELSE tests_ok AND lint_ok END AS passed,
       CASE WHEN rule = 4 THEN last_errors END AS last_errors
FROM j"""


oracle("a4_run_verdict", verdict_sql(
    "CASE WHEN NOT has_rel THEN 1 WHEN n_checks IS NULL THEN 2 WHEN coalesce(no_tests_ran, false) THEN 3 ELSE 4 END"),
    "v_checks", "checks_last", "digest")
oracle("a4_run_verdict_class", verdict_sql("CASE WHEN NOT has_rel THEN 1 ELSE 4 END"), "v_checks", "checks_last", "digest")

cte("change_events", """
SELECT user_id AS run_id, ts, event_id, 'mod_' || CAST(CAST(floor(value) AS BIGINT) % 12 AS VARCHAR) || '.py' AS file
FROM events""")
cte("updated", """
SELECT run_id, string_agg(file, ',' ORDER BY ts, event_id) AS files
FROM (SELECT *, row_number() OVER (PARTITION BY run_id, file ORDER BY ts, event_id) AS rn FROM change_events)
WHERE rn = 1 GROUP BY run_id""", "change_events")
oracle("a7_updated_files", "SELECT run_id, files FROM updated", "updated")
oracle("a8_changed_files", """
SELECT run_id, string_agg(DISTINCT f, ',' ORDER BY f) AS files FROM (
  SELECT run_id, file AS f FROM change_events
  UNION ALL
  SELECT DISTINCT run_id, 'new_' || CAST(run_id % 3 AS VARCHAR) || '.py' FROM change_events WHERE run_id % 2 = 0)
GROUP BY run_id""", "change_events")

# -- decisions ---------------------------------------------------------------
# Straight from the rule: attempt k of a run has retry counter k (every
# earlier kept attempt was a retry); rows after the first terminal go.
cte("ledger", """
SELECT run_id, agent_id, event_id, ts, errors, attempt, decision FROM (
  SELECT *, coalesce(sum(CASE WHEN decision <> 'retry' THEN 1 ELSE 0 END) OVER (
              PARTITION BY run_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
  FROM (SELECT *, CASE WHEN tests_passed = false AND attempt < 3 THEN 'retry'
                       WHEN tests_passed = false THEN 'end'
                       WHEN tests_passed THEN 'commit' ELSE 'end' END AS decision
        FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) - 1 AS attempt
              FROM v_attempts)))
WHERE done = 0""", "v_attempts")
oracle("w1_retry_ledger", "SELECT run_id, event_id, attempt, decision FROM ledger", "ledger")
oracle("w3_carry_errors", """
SELECT run_id, event_id, lag(errors) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS carried_errors
FROM ledger""", "ledger")

# Shared budget: a run's leading failures L; runs of an agent in order of
# their first attempt; budget = 3 - min(3, sum of L of earlier runs).
oracle("w2_shared_budget", """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) - 1 AS attempt
           FROM v_attempts),
r AS (SELECT run_id, agent_id, min(ts) AS t0, min(event_id) AS e0,
             coalesce(min(attempt) FILTER (WHERE tests_passed IS NULL OR tests_passed), count(*)) AS lead_fail
      FROM a GROUP BY run_id, agent_id),
b AS (SELECT *, 3 - least(3, coalesce(sum(lead_fail) OVER (PARTITION BY agent_id ORDER BY t0, e0, run_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS budget FROM r)
SELECT a.run_id, a.agent_id, a.event_id, a.attempt,
       CASE WHEN a.attempt < least(b.lead_fail, b.budget) THEN 'retry'
            WHEN a.tests_passed = false THEN 'end'
            WHEN a.tests_passed THEN 'commit' ELSE 'end' END AS decision
FROM a JOIN b USING (run_id) WHERE a.attempt <= least(b.lead_fail, b.budget)""", "v_attempts")

oracle("w4_step_durations", """
SELECT user_id AS run_id, event_id, event_type,
       (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1000000.0
         AS step_seconds
FROM events""")
oracle("w4_run_spans", """
SELECT user_id AS run_id, count(*) AS n_records, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS span_seconds
FROM events GROUP BY user_id""")

# -- run logs ----------------------------------------------------------------
LEVEL_SQL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARNING' ELSE 'INFO' END"
MESSAGE_SQL = """CASE event_type
  WHEN 'signup' THEN '=== starting test_and_lint phase ==='
  WHEN 'view' THEN 'agent_respond() asked for a plan'
  WHEN 'purchase' THEN 'Workflow completed successfully!'
  WHEN 'click' THEN 'Tests did not pass. Retrying once more'
  ELSE 'check failed for f' || CAST(event_id % 7 AS VARCHAR) || '.py:' || chr(10) ||
       'STDOUT:' || chr(10) || props END"""
cte("log_records", f"""
SELECT 'run_' || CAST(user_id AS VARCHAR) || '.log' AS source_file, user_id AS run_id, event_id, ts,
       {LEVEL_SQL} AS level, {MESSAGE_SQL} AS message
FROM events""")
# Printed records: headers with their times (NULL for an impossible date) and
# the two lines before the first header of every ninth run.
cte("log_printed", """
SELECT source_file, run_id, event_id, level, message,
       CASE WHEN event_id % 97 <> 5 THEN epoch_ms(date_trunc('millisecond', ts)) END AS ts_ms,
       (run_id % 9 = 0 AND row_number() OVER w = 1) AS headless,
       (CASE WHEN run_id % 9 = 0 THEN 2 ELSE 0 END + 1 +
        coalesce(sum(1 + length(message) - length(replace(message, chr(10), ''))) OVER (
          PARTITION BY run_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS line_no
FROM log_records WINDOW w AS (PARTITION BY run_id ORDER BY event_id)""", "log_records")
cte("log_parsed", """
SELECT source_file, line_no, ts_ms, level, message FROM log_printed
UNION ALL
SELECT source_file, k, NULL, NULL, CASE k WHEN 1 THEN 'Loading settings' ELSE 'done' END
FROM log_printed, unnest([1, 2]) AS u(k) WHERE headless""", "log_printed")
oracle("s5_run_logs", "SELECT source_file, line_no, ts_ms, level, message FROM log_parsed", "log_parsed")
oracle("a10_trace_profile", """
SELECT source_file, count(*) AS n_records,
       count(*) FILTER (WHERE level = 'INFO') AS n_info,
       count(*) FILTER (WHERE level = 'WARNING') AS n_warning,
       count(*) FILTER (WHERE level = 'ERROR') AS n_error,
       count(*) FILTER (WHERE level = 'DEBUG') AS n_debug,
       count(*) FILTER (WHERE level = 'CRITICAL') AS n_critical,
       count(*) FILTER (WHERE message LIKE '=% starting % phase =%') AS n_phases,
       count(*) FILTER (WHERE message LIKE '=% starting test_and_lint phase =%') AS n_check_phases,
       count(*) FILTER (WHERE message LIKE '=% starting code_generation phase =%') AS n_code_phases,
       count(*) FILTER (WHERE message LIKE '=% starting test_generation phase =%') AS n_test_gen_phases,
       count(*) FILTER (WHERE contains(message, 'agent_respond()')) AS n_calls,
       count(*) FILTER (WHERE starts_with(message, 'Tests did not pass. Retrying')) AS n_retries
FROM log_parsed GROUP BY source_file""", "log_parsed")

oracle("s6_final_states", """
SELECT doc_id,
       CASE WHEN doc_id % 9 NOT IN (0, 4) THEN 'doc ' || CAST(doc_id AS VARCHAR) END AS github_issue,
       CASE WHEN doc_id % 9 NOT IN (0, 4) THEN quality = 1 END AS tests_passed,
       CASE WHEN doc_id % 9 NOT IN (0, 4) AND doc_id % 5 <> 0 THEN toxic = 0 END AS lint_passed,
       CASE WHEN doc_id % 9 NOT IN (0, 4) THEN quality = 1 AND toxic = 0 END AS passed,
       CASE WHEN doc_id % 9 NOT IN (0, 4) THEN CAST(2 AS BIGINT) END AS n_relevant,
       doc_id % 9 IN (0, 4) AS is_corrupt
FROM labels""")
oracle("s7_state_report", """
SELECT doc_id, CAST(to_json({
  'github_issue': 'doc ' || CAST(doc_id AS VARCHAR),
  'project_context': CAST(NULL AS VARCHAR),
  'plan': {'relevant_files': ['src/d' || CAST(doc_id AS VARCHAR) || '.py',
                              'tests/test_d' || CAST(doc_id AS VARCHAR) || '.py'],
           'source_files': ['src/d' || CAST(doc_id AS VARCHAR) || '.py'],
           'test_files': ['tests/test_d' || CAST(doc_id AS VARCHAR) || '.py'],
           'is_test_generation_issue': doc_id % 2 = 0},
  'code_changes': {'updated_files': ['src/d' || CAST(doc_id AS VARCHAR) || '.py'],
                   'commit_message': CAST(NULL AS VARCHAR)},
  'test_results': {'test_outputs': MAP([ 'tests/test_d' || CAST(doc_id AS VARCHAR) || '.py' ],
                                       [ CASE WHEN quality = 1 THEN '[Exit code: 0]' ELSE '[Exit code: 1]' END ]),
                   'tests_passed': quality = 1},
  'lint_results': CASE WHEN doc_id % 5 <> 0 THEN {'lint_outputs': MAP([]::VARCHAR[], []::VARCHAR[]), 'lint_passed': toxic = 0} END,
  'passed': quality = 1 AND toxic = 0,
  'last_errors': CASE WHEN quality <> 1 THEN 'Test failure in tests/test_d' || CAST(doc_id AS VARCHAR) || '.py' END,
  'retry_count': doc_id % 4
}) AS VARCHAR) AS state_json FROM labels""")

# -- benchmark ---------------------------------------------------------------
cte("instances", """
SELECT b.item_id AS pos,
       CASE WHEN b.item_id % 11 <> 0 THEN 'inst-' || CAST(b.item_id AS VARCHAR) END AS instance_id,
       CASE WHEN b.item_id % 13 = 0 THEN NULL
            WHEN b.item_id % 3 = 1 THEN 'https://github.com/' || concat('org', b.item_id % 5, '/repo', b.item_id % 25)
            WHEN b.item_id % 3 = 2 THEN concat('org', b.item_id % 5, '/repo', b.item_id % 25) || '.git'
            ELSE concat('org', b.item_id % 5, '/repo', b.item_id % 25) END AS repo,
       CASE WHEN b.item_id % 17 <> 0 THEN b.text END AS problem_statement,
       CASE WHEN b.item_id % 19 <> 0 THEN substr(sha256(b.text), 1, 12) END AS base_commit,
       CASE WHEN b.item_id % 7 IN (3, 5) THEN [] ELSE coalesce(l.f2p, []) END AS f2p_list,
       coalesce(l.p2p, []) AS p2p_list
FROM benchmark b LEFT JOIN (
  SELECT l_orderkey,
         list('tests/test_f' || CAST(l_linenumber AS VARCHAR) || '.py::test_' || CAST(l_partkey AS VARCHAR)
              ORDER BY 'tests/test_f' || CAST(l_linenumber AS VARCHAR) || '.py::test_' || CAST(l_partkey AS VARCHAR))
           FILTER (WHERE l_returnflag = 'R') AS f2p,
         list('tests/test_f' || CAST(l_linenumber AS VARCHAR) || '.py::test_' || CAST(l_partkey AS VARCHAR)
              ORDER BY 'tests/test_f' || CAST(l_linenumber AS VARCHAR) || '.py::test_' || CAST(l_partkey AS VARCHAR))
           FILTER (WHERE l_returnflag <> 'R') AS p2p
  FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = b.item_id""")

oracle("f1_validate_instances", """
SELECT pos, CASE WHEN instance_id IS NULL THEN 'missing instance_id'
                 WHEN repo IS NULL THEN 'missing repo'
                 WHEN problem_statement IS NULL OR base_commit IS NULL THEN 'missing required fields' END AS reason
FROM instances""", "instances")

CLONE_SQL = """CASE WHEN starts_with(repo, 'http') THEN repo
     WHEN ends_with(repo, '.git') THEN 'https://github.com/' || repo
     ELSE 'https://github.com/' || repo || '.git' END"""

oracle("f2_instance_states", f"""
SELECT pos, instance_id, {CLONE_SQL} AS repo_link,
       'SWE-bench instance ' || coalesce(instance_id, '') AS project_description,
       'Python' AS language, 'pytest,ruff,black' AS dependencies,
       coalesce(problem_statement, '') AS github_issue,
       array_to_string(list_concat(f2p_list, p2p_list), '|') AS relevant_files
FROM instances""", "instances")

oracle("f3_test_ids", """
SELECT pos, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS test_pos, unnest(l) AS test_id
FROM (SELECT pos, list_concat(f2p_list, p2p_list) AS l FROM instances)""", "instances")

oracle("f4_repo_key", """
WITH v AS (
  SELECT page_id,
         CASE WHEN page_id % 8 = 4 THEN url || '/'
              WHEN page_id % 4 = 1 THEN url || '.git'
              WHEN page_id % 4 = 2 THEN 'git@' || regexp_extract(url, '://([^/]+)', 1) || ':org/' ||
                                        CAST(page_id AS VARCHAR) || '.git'
              WHEN page_id % 4 = 3 THEN 'org/' || CAST(page_id AS VARCHAR)
              ELSE url END AS url
  FROM pages),
b AS (SELECT *, CASE WHEN ends_with(url, '.git') THEN url[1:length(url) - 4] ELSE url END AS base,
             rtrim(url, '/') AS stripped FROM v)
SELECT page_id, url,
       CASE WHEN starts_with(base, 'git@') THEN
              CASE WHEN contains(base, ':') THEN substr(base, strpos(base, ':') + 1) ELSE base END
            WHEN starts_with(base, 'https://') OR starts_with(base, 'http://') THEN
              string_split(base, '/')[-2] || '/' || string_split(base, '/')[-1] END AS repo_key,
       CASE WHEN ends_with(string_split(stripped, '/')[-1], '.git')
            THEN string_split(stripped, '/')[-1][1:length(string_split(stripped, '/')[-1]) - 4]
            ELSE string_split(stripped, '/')[-1] END AS dir_name
FROM b""")

oracle("f5_repo_urls", f"""
SELECT issue_id, clone_url,
       CASE WHEN issue_id IS NOT NULL AND issue_id <> 0
            THEN 'https://github.com/' || replace(replace(clone_url, 'https://github.com/', ''), '.git', '') ||
                 '/issues/' || CAST(issue_id AS VARCHAR)
            ELSE 'N/A' END AS issue_url
FROM (SELECT issue_id, {CLONE_SQL} AS clone_url FROM v_issues)""", "v_issues")

oracle("s4_first_instances", "SELECT pos, instance_id, repo FROM instances ORDER BY pos LIMIT 3", "instances")

cte("label_runs", """
SELECT 'inst-' || CAST(doc_id AS VARCHAR) AS instance_id, quality = 1 AND toxic = 0 AS passed,
       'src/d' || CAST(doc_id AS VARCHAR) || '.py' AS updated_files, quality = 1 AS tests_ok, toxic = 0 AS lint_ok
FROM labels""")
RESULT_COLS = "i.repo, i.instance_id, r.passed AS tests_passed, r.updated_files, r.tests_ok, r.lint_ok"
oracle("j7_join_results", f"SELECT {RESULT_COLS} FROM instances i JOIN label_runs r USING (instance_id)",
       "instances", "label_runs")
VALID_SQL = "instance_id IS NOT NULL AND repo IS NOT NULL AND problem_statement IS NOT NULL AND base_commit IS NOT NULL"
oracle("s8_collect_results", f"""
SELECT {RESULT_COLS} FROM instances i JOIN label_runs r USING (instance_id) WHERE {VALID_SQL}""",
       "instances", "label_runs")
oracle("s8_quarantine", f"""
SELECT pos, instance_id, repo, CASE WHEN instance_id IS NULL THEN 'missing instance_id'
                 WHEN repo IS NULL THEN 'missing repo'
                 ELSE 'missing required fields' END AS reason
FROM instances WHERE NOT ({VALID_SQL})
UNION ALL
SELECT pos, instance_id, repo, 'no run result' FROM instances i
WHERE {VALID_SQL} AND NOT EXISTS (SELECT 1 FROM label_runs r WHERE r.instance_id = i.instance_id)""",
       "instances", "label_runs")

oracle("a9_benchmark_summary", f"""
WITH per AS (
  SELECT run_id, {repo_of('run_id')} AS repo, bool_or(decision = 'commit') AS passed,
         count(*) FILTER (WHERE decision = 'retry') AS retries,
         (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS dur
  FROM ledger GROUP BY run_id)
SELECT coalesce(repo, 'ALL') AS repo, count(*) AS instances, count(*) FILTER (WHERE passed) AS passed,
       round(count(*) FILTER (WHERE passed) / count(*), 6) AS success_share,
       round(avg(retries), 6) AS mean_retries, round(avg(dur), 6) AS mean_duration_seconds
FROM per GROUP BY ROLLUP (repo)""", "ledger")

# -- text jobs ---------------------------------------------------------------
WS = (r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")


def py_strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '\\A[{WS}]+|[{WS}]+\\z', '', 'g')"


oracle("f6_open_issues", """
SELECT issue_id, CASE WHEN coalesce(body, '') = '' THEN 'issue ' || CAST(number AS VARCHAR) || ': empty body'
                      WHEN lower(state) <> 'open' THEN 'issue ' || CAST(number AS VARCHAR) || ': state is not open'
                 END AS reason
FROM v_issues""", "v_issues")

MD = (r"CASE WHEN i = 1 THEN regexp_replace(x, '(?m)^#{1,6}[ \t]+', '', 'g') "
      r"ELSE regexp_replace(x, '\n#{1,6}[ \t]+', chr(10), 'g') END")
for pat, rep in [(r"\*\*([^*\n]+)\*\*", r"\1"), (r"__([^_\n]+)__", r"\1"),
                 (r"<[a-zA-Z/][^<>\n]*>", ""), (r"[ \t]+\n", None), (r"\n{2,}", None)]:
    MD = f"regexp_replace({MD}, '{pat}', " + (f"'{rep}'" if rep is not None else "chr(10)") + ", 'g')"


def markdown_sql(col: str) -> str:
    """code (odd parts) kept, the rules applied to the rest."""
    parts = (f"string_split(regexp_replace(replace({col}, chr(1), ''), " + r"'(?s)(```.*?(?:```|\z)|`[^`\n]+`)', "
             r"chr(1) || '\1' || chr(1), 'g'), chr(1))")
    return py_strip_sql(f"array_to_string(list_transform({parts}, lambda x, i: CASE WHEN i % 2 = 1 THEN {MD} "
                        "WHEN starts_with(x, '```') THEN x ELSE x[2:length(x) - 1] END), '')")


oracle("f7_strip_markdown", f"SELECT issue_id, {markdown_sql('body')} AS text FROM v_issues", "v_issues")

oracle("f14_clean_responses", f"""
WITH r AS (SELECT conv_id, turn,
                  CASE WHEN turn % 4 = 1 THEN '```python' || chr(10) || text || chr(10) || '```'
                       WHEN turn % 4 = 3 THEN '  ```' || chr(10) || text || chr(10) || '```  ' || chr(10)
                       ELSE text END AS response
           FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn,
       {py_strip_sql("regexp_replace(" + py_strip_sql("response") + ", '(?m)^```[a-zA-Z]*[" + WS + "]*|```$', '', 'g')")}
         AS cleaned
FROM r""")

oracle("f15_diff_gate", f"""
WITH r AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN '  diff --git a/x b/x' || chr(10) || text
                                      ELSE text END AS response FROM conversations)
SELECT conv_id, turn,
       CASE WHEN starts_with(regexp_replace(response, '\\A[{WS}]+', ''), 'diff ') THEN response ELSE '' END AS patch
FROM r""")

oracle("f16_token_count", f"SELECT doc_id, len(regexp_extract_all(text, '[^{WS}]+')) AS n_tokens FROM documents")

PHRASES = "test case|test file|add test|write test|unit test|unit tests|integration test|pytest|jest|mocha|" \
          "add coverage|missing test|missing tests"
oracle("f17_test_issue_flag", f"""
SELECT doc_id, regexp_matches(lower(text || CASE WHEN doc_id % 10 = 0 THEN ' Please add Unit Tests for this.'
                                                 WHEN doc_id % 10 = 5 THEN ' Covered by PyTest?' ELSE '' END),
                              '{PHRASES}') AS is_test_issue
FROM documents""")

oracle("f21_classify_failures", """
WITH e AS (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, event_type FROM events),
s AS (SELECT event_id,
             CASE WHEN event_id % 5 = 0 THEN 'web/app.js' ELSE 'tests/test_x.py' END AS file,
             CASE WHEN event_type = 'error' THEN
               'Traceback (most recent call last):' || chr(10) || 'ModuleNotFoundError: No module named ''mod' ||
               CAST(k % 5 AS VARCHAR) || '''' ||
               CASE WHEN event_id % 3 = 0 THEN chr(10) || 'ModuleNotFoundError: No module named ''mod' ||
                                               CAST((k + 1) % 5 AS VARCHAR) || '''' ELSE '' END ||
               CASE WHEN event_id % 4 = 0 THEN chr(10) || 'ImportError: build it with pip install -e . first'
                    ELSE '' END
             ELSE '' END AS stderr
      FROM e)
SELECT event_id,
       CASE WHEN ends_with(file, '.py') AND contains(stderr, 'ModuleNotFoundError') AND contains(stderr, 'No module named')
            THEN array_to_string(list_sort(list_distinct(
                   regexp_extract_all(stderr, 'ModuleNotFoundError: No module named ''([^'']+)''', 1))), ',')
            ELSE '' END AS missing_modules,
       ends_with(file, '.py') AND contains(stderr, 'ImportError') AND
         (contains(stderr, 'pip install -e .') OR contains(stderr, 'python setup.py build_ext --inplace')) AS needs_build
FROM s""")

oracle("f24_previews", "SELECT doc_id, substring(text, 1, 300) AS preview_300, substring(text, 1, 500) AS preview_500 "
                       "FROM documents")

oracle("d1_reprice", """
SELECT l_orderkey, CAST(sum(CASE WHEN p <= 0 THEN CAST(0 AS DECIMAL(18,6))
                                 ELSE round(p * (1 - greatest(d, CAST(0 AS DECIMAL(18,6))) * CAST(0.01 AS DECIMAL(18,6))), 2) END) AS DOUBLE)
                     AS total
FROM (SELECT l_orderkey, CAST(l_extendedprice AS DECIMAL(18,6)) AS p,
             CAST(CAST(l_discount AS DECIMAL(18,6)) * 100 AS DECIMAL(18,6)) AS d FROM lineitem)
GROUP BY l_orderkey""")

oracle("d2_convert_units", """
SELECT event_id, CAST(round(CAST(value AS DECIMAL(18,6)) * 9 / 5 + 32, 2) AS DOUBLE) AS value_f,
       CAST(round(CAST((CAST(value AS DECIMAL(18,6)) - 32) * 5 / 9 AS DECIMAL(18,6)), 2) AS DOUBLE) AS value_c
FROM events""")

oracle("d3_email_profile", f"""
WITH t AS (SELECT source, unnest(regexp_extract_all(text, '[^{WS}]*@[^{WS}]*')) AS token FROM documents)
SELECT source, coalesce(token <> '' AND contains(token, '@') AND contains(string_split(token, '@')[-1], '.'), false)
         AS valid,
       count(*) AS n_tokens
FROM t GROUP BY ALL""")

# -- plans -------------------------------------------------------------------
IS_TEST_SQL = "(contains(lower({n}), 'test') OR contains(lower({n}), 'spec'))"
cte("plans", f"""
SELECT issue_id AS run_id, repo,
       list(path ORDER BY path) AS relevant_files,
       coalesce(list(path ORDER BY path) FILTER (WHERE NOT is_t), []) AS source_files,
       coalesce(list(path ORDER BY path) FILTER (WHERE is_t), []) AS test_files,
       issue_id % 4 = 0 AS is_test_generation_issue,
       CASE issue_id % 5 WHEN 0 THEN 'Python' WHEN 1 THEN 'TypeScript' WHEN 2 THEN 'JavaScript/React'
                         WHEN 3 THEN NULL ELSE 'Go' END AS language_ctx
FROM (SELECT *, {IS_TEST_SQL.format(n=name_of('path'))} AS is_t FROM candidates)
GROUP BY issue_id, repo""", "candidates")

SUFFIX_LANG = ("CASE lower({s}) WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' "
               "WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' END")
FIRST_KNOWN = ("list_filter(relevant_files, lambda f: lower(" + suffix_of("f") +
               ") IN ('.py', '.ts', '.tsx', '.js', '.jsx'))[1]")
LANG_SQL = f"""CASE WHEN contains(lower(language_ctx), 'python') THEN 'python'
     WHEN contains(lower(language_ctx), 'typescript') OR contains(lower(language_ctx), 'ts') THEN 'typescript'
     WHEN contains(lower(language_ctx), 'javascript') OR contains(lower(language_ctx), 'js') THEN 'javascript'
     ELSE coalesce({SUFFIX_LANG.format(s=suffix_of(FIRST_KNOWN))}, 'python') END"""
cte("plans_lang", f"SELECT *, {LANG_SQL} AS language FROM plans", "plans")

BASE_SQL = "regexp_replace(" + stem_of("source_files[1]") + ", '^test_', '')"
cte("plans13", f"""
SELECT * REPLACE (CASE WHEN len(test_files) > 0 THEN test_files ELSE [
  CASE WHEN len(source_files) > 0 THEN
         CASE language WHEN 'python' THEN 'test_' || {BASE_SQL} || '.py'
                       WHEN 'typescript' THEN {BASE_SQL} || '.test.ts'
                       ELSE {BASE_SQL} || '.test.js' END
       WHEN language = 'python' THEN 'test_generated.py' ELSE 'generated.test.ts' END] END AS test_files)
FROM plans_lang""", "plans_lang")

cte("snapshot", "SELECT repo, path, min(content) AS content FROM v_repo_files GROUP BY repo, path", "v_repo_files")
cte("test_dirs", """
SELECT repo, CASE WHEN bool_or(starts_with(path, 'tests/')) THEN 'tests'
                  WHEN bool_or(starts_with(path, 'test/')) THEN 'test' ELSE 'tests' END AS test_dir
FROM v_repo_files GROUP BY repo""", "v_repo_files")
cte("plans11", """
SELECT p.* REPLACE (list_transform(p.test_files,
         lambda x: CASE WHEN contains(x, '/') THEN x ELSE coalesce(d.test_dir, 'tests') || '/' || x END) AS test_files)
FROM plans13 p LEFT JOIN test_dirs d USING (repo)""", "plans13", "test_dirs")

oracle("f10_lint_targets", f"""
SELECT run_id, pos, path FROM (
  SELECT run_id, CAST(generate_subscripts(relevant_files, 1) - 1 AS INTEGER) AS pos, unnest(relevant_files) AS path
  FROM plans)
WHERE ends_with(path, '.py') AND NOT contains(lower({stem_of('path')}), 'test')""", "plans")
oracle("f12_language", "SELECT run_id, language FROM plans_lang", "plans_lang")
oracle("f13_infer_test_files", "SELECT run_id, array_to_string(test_files, '|') AS test_files FROM plans13", "plans13")
oracle("f11_normalize_test_paths", "SELECT run_id, array_to_string(test_files, '|') AS test_files FROM plans11",
       "plans11")
cte("planned_tests", "SELECT run_id, repo, unnest(test_files) AS path FROM plans11", "plans11")
oracle("j2_existing_tests", """
SELECT run_id, path FROM planned_tests t WHERE EXISTS (SELECT 1 FROM snapshot s WHERE s.repo = t.repo AND s.path = t.path)""",
       "planned_tests", "snapshot")
oracle("j2_missing_tests", """
SELECT run_id, path FROM planned_tests t
WHERE NOT EXISTS (SELECT 1 FROM snapshot s WHERE s.repo = t.repo AND s.path = t.path)""", "planned_tests", "snapshot")

cte("effective", f"""
WITH pt AS (SELECT run_id, repo, CAST(generate_subscripts(test_files, 1) - 1 AS INTEGER) AS pos,
                   unnest(test_files) AS path FROM plans11),
s1 AS (SELECT run_id, repo, pos, path, 'planned' AS stage FROM pt
       WHERE EXISTS (SELECT 1 FROM snapshot s WHERE s.repo = pt.repo AND s.path = pt.path)),
rt AS (SELECT run_id, repo, CAST(generate_subscripts(relevant_files, 1) - 1 AS INTEGER) AS pos,
              unnest(relevant_files) AS path FROM plans11
       WHERE run_id NOT IN (SELECT run_id FROM s1))
SELECT * FROM s1
UNION ALL
SELECT run_id, repo, pos, path, 'relevant' FROM rt
WHERE {IS_TEST_SQL.format(n=name_of('path'))}
  AND EXISTS (SELECT 1 FROM snapshot s WHERE s.repo = rt.repo AND s.path = rt.path)""", "plans11", "snapshot")
oracle("j3_effective_tests", "SELECT run_id, pos, path, stage FROM effective", "effective")
oracle("f22_check_worklist", f"""
WITH cfg AS (SELECT repo, bool_or(contains(content, 'addopts') AND contains(content, '--doctest-rst')) AS doctest
             FROM v_repo_config WHERE path = 'pyproject.toml' GROUP BY repo),
c AS (SELECT e.run_id, e.path,
             CASE WHEN lower({suffix_of('e.path')}) = '.py'
                    THEN CASE WHEN coalesce(cfg.doctest, false) THEN 'pytest' ELSE 'pytest ' || e.path END
                  WHEN lower({suffix_of('e.path')}) IN ('.js', '.jsx', '.ts', '.tsx') THEN 'npm run test' END AS command
      FROM effective e LEFT JOIN cfg USING (repo))
SELECT run_id, path, command FROM c WHERE command IS NOT NULL""", "effective", "v_repo_config")

oracle("j4_attach_content", """
SELECT t.run_id, t.path, coalesce(s.content, '') AS content
FROM (SELECT run_id, repo, unnest(source_files) AS path FROM plans) t
LEFT JOIN snapshot s ON s.repo = t.repo AND s.path = t.path""", "plans", "snapshot")

cte("summaries", """
SELECT c.run_id, string_agg(c.path || ':' || chr(10) || substring(s.content, 1, 500), chr(10) || chr(10)
                            ORDER BY c.path) AS summary
FROM (SELECT DISTINCT run_id, repo, unnest(list_concat(source_files, test_files)) AS path FROM plans11) c
JOIN snapshot s ON s.repo = c.repo AND s.path = c.path
GROUP BY c.run_id""", "plans11", "snapshot")
oracle("j5_change_summaries", "SELECT run_id, summary FROM summaries", "summaries")
oracle("j5_summary_pieces", """
SELECT run_id, row_number() OVER w - 1 AS piece,
       coalesce(sum(length(t) + 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", t AS text
FROM (SELECT c.run_id, c.path, c.path || ':' || chr(10) || substring(s.content, 1, 500) AS t
      FROM (SELECT DISTINCT run_id, repo, unnest(list_concat(source_files, test_files)) AS path FROM plans11) c
      JOIN snapshot s ON s.repo = c.repo AND s.path = c.path)
WINDOW w AS (PARTITION BY run_id ORDER BY path)""", "plans11", "snapshot")

cte("plan_responses", """
SELECT doc_id,
       CASE doc_id % 6
         WHEN 0 THEN '{"relevant_files": ["src/d' || CAST(doc_id AS VARCHAR) || '.py", "tests/test_d' ||
                     CAST(doc_id AS VARCHAR) || '.py"], "source_files": ["src/d' || CAST(doc_id AS VARCHAR) ||
                     '.py"], "test_files": ["test_d' || CAST(doc_id AS VARCHAR) ||
                     '.py"], "is_test_generation_issue": true}'
         WHEN 1 THEN '{"source_files": ["src/d' || CAST(doc_id AS VARCHAR) || '.py"]}'
         WHEN 2 THEN ''
         WHEN 3 THEN CASE WHEN doc_id % 12 = 3 THEN 'not json at all'
                          WHEN doc_id % 24 = 9 THEN '{' || chr(39) || 'relevant_files' || chr(39) || ': []}'
                          ELSE '{"relevant_files": ["a.py"]} and more' END
         WHEN 4 THEN '{"relevant_files": "src/d' || CAST(doc_id AS VARCHAR) || '.py"}'
         ELSE '{"relevant_files": ["a.py"], "extra": 1, "is_test_generation_issue": false}' END AS response,
       ['src/d' || CAST(doc_id AS VARCHAR) || '.py', 'tests/test_d' || CAST(doc_id AS VARCHAR) || '.py'] AS candidates
FROM labels""")
ARR_OK = "coalesce(json_type(response, '$.{k}'), 'ARRAY') IN ('ARRAY', 'NULL')"
cte("parsed", f"""
WITH v AS (
  SELECT *, CASE WHEN json_valid(response) THEN json_type(response) = 'OBJECT'
              AND {ARR_OK.format(k='relevant_files')} AND {ARR_OK.format(k='source_files')}
              AND {ARR_OK.format(k='test_files')}
              AND coalesce(json_type(response, '$.is_test_generation_issue'), 'BOOLEAN') IN ('BOOLEAN', 'NULL')
              ELSE false END AS ok
  FROM plan_responses)
SELECT doc_id, coalesce(ok, false) AS parsed_ok,
       CASE WHEN ok THEN coalesce(from_json(json_extract(response, '$.relevant_files'), '["VARCHAR"]'), [])
            ELSE candidates END AS relevant_files,
       CASE WHEN ok THEN coalesce(from_json(json_extract(response, '$.source_files'), '["VARCHAR"]'), [])
            ELSE candidates END AS source_files,
       CASE WHEN ok THEN coalesce(from_json(json_extract(response, '$.test_files'), '["VARCHAR"]'), [])
            ELSE [] END AS test_files,
       CASE WHEN ok THEN coalesce(CAST(json_extract(response, '$.is_test_generation_issue') AS BOOLEAN), false)
            ELSE false END AS is_test_generation_issue
FROM v""", "plan_responses")
oracle("f18_parse_plans", """
SELECT doc_id, parsed_ok, array_to_string(relevant_files, ',') AS relevant_files,
       array_to_string(source_files, ',') AS source_files, array_to_string(test_files, ',') AS test_files,
       is_test_generation_issue
FROM parsed""", "parsed")
oracle("f25_route", """
SELECT doc_id, CASE WHEN is_test_generation_issue AND len(test_files) > 0 THEN 'test_generation'
                    WHEN NOT is_test_generation_issue AND len(source_files) > 0 THEN 'code_generation'
                    ELSE 'none' END AS branch
FROM parsed""", "parsed")
oracle("f19_dependencies", f"""
SELECT p_partkey, array_to_string(l, '|') AS deps, len(l) AS n_deps
FROM (SELECT p_partkey, list_filter(list_transform(string_split(' ' || replace(p_type, ' ', ' , ') || ',,', ','),
                                                   lambda x: {py_strip_sql('x')}), lambda x: x <> '') AS l
      FROM part)""")

# -- prompts -----------------------------------------------------------------
PLANNING_TASK = ("Choose the files needed to resolve the issue. Answer with one JSON object with the keys "
                 "relevant_files, source_files, test_files and is_test_generation_issue.")
oracle("f20_planning_prompts", f"""
SELECT i.issue_id, '{PLANNING_TASK}' || chr(10) || chr(10) || 'Issue:' || chr(10) || i.body || chr(10) || chr(10) ||
       'Candidate files:' || chr(10) || array_to_string(c.l, ', ') AS prompt
FROM v_issues i JOIN (SELECT issue_id, list(path ORDER BY path) AS l FROM cand_all GROUP BY issue_id) c
  USING (issue_id)""", "v_issues", "cand_all")

LANG_WORD = ("CASE WHEN coalesce(language, '') = '' THEN '' "
             "ELSE upper(substr(language, 1, 1)) || lower(substr(language, 2)) || ' ' END")
ERR = "CASE WHEN run_id % 3 = 0 THEN '  Test failure in tests/test_x.py:' || chr(10) || 'assert 1 == 2  ' END"
OTHERS = ("'[' || array_to_string(list_transform(list_filter(relevant_files, lambda f: f <> path), "
          "lambda f: '''' || f || ''''), ', ') || ']'")
FILE_PROMPT_BASE = """
WITH t AS (SELECT run_id, repo, relevant_files, language, unnest({files}) AS path FROM {src}),
c AS (SELECT t.*, coalesce(s.content, '') AS content, i.body AS issue, {err} AS errors
      FROM t LEFT JOIN snapshot s ON s.repo = t.repo AND s.path = t.path
      JOIN v_issues i ON i.issue_id = t.run_id)
SELECT run_id, path, {prompt} AS prompt FROM c"""
CODE_PROMPT = ("'Rewrite the ' || " + LANG_WORD + " || 'source file below so that it resolves the issue. "
               "Return the whole file, no fences.' || chr(10) || chr(10) || "
               "CASE WHEN coalesce(errors, '') <> '' THEN 'Errors of the last run (fix them first):' || chr(10) || "
               "chr(10) || " + py_strip_sql("errors") + " || chr(10) ELSE '' END || "
               "'Issue:' || chr(10) || issue || chr(10) || chr(10) || 'Source file: ' || path || chr(10) || "
               "'Current content:' || chr(10) || content || chr(10) || chr(10) || "
               "'Other relevant files (read only):' || chr(10) || " + OTHERS + " || chr(10)")
TEST_PROMPT = ("'Rewrite the ' || " + LANG_WORD + " || 'test file below with a few focused tests for the issue. "
               "Return the whole file, no fences.' || chr(10) || chr(10) || "
               "'Issue:' || chr(10) || issue || chr(10) || chr(10) || 'Test file: ' || path || chr(10) || "
               "'Current content:' || chr(10) || content || chr(10) || chr(10) || "
               "'Other relevant files (read only):' || chr(10) || " + OTHERS + " || chr(10) || "
               "CASE WHEN coalesce(errors, '') <> '' THEN chr(10) || chr(10) || '[Errors of the last run:]' || "
               "chr(10) || " + py_strip_sql("errors") + " || chr(10) || 'Keep passing tests only.' ELSE '' END")
oracle("f20_code_prompts", FILE_PROMPT_BASE.format(files="source_files", src="plans_lang", err=ERR,
                                                   prompt=CODE_PROMPT), "plans_lang", "snapshot", "v_issues")
oracle("f20_test_prompts", FILE_PROMPT_BASE.format(files="test_files", src="plans11", err=ERR,
                                                   prompt=TEST_PROMPT), "plans11", "snapshot", "v_issues")
oracle("f20_commit_prompts", """
SELECT i.issue_id AS run_id,
       'Write a short conventional commit message for these changes.' || chr(10) || 'Issue:' || chr(10) || i.body ||
       chr(10) || chr(10) || 'Files touched (first characters of each):' || chr(10) || coalesce(s.summary, '') AS prompt
FROM v_issues i LEFT JOIN summaries s ON s.run_id = i.issue_id""", "v_issues", "summaries")
oracle("f20_patch_prompts", """
SELECT pos, 'Return a unified diff (starting with ''diff --git'') that resolves the problem, or nothing.' ||
            chr(10) || chr(10) || 'Problem:' || chr(10) ||
            coalesce(problem_statement, '') AS prompt
FROM instances""", "instances")

oracle("j8_replay_responses", """
WITH rec AS (SELECT sha256(prompt) AS h, arg_min(response, call_id) AS response FROM v_calls GROUP BY 1)
SELECT c.conv_id, c.turn, coalesce(r.response, '') AS response
FROM conversations c LEFT JOIN rec r ON r.h = sha256(c.text)
WHERE c.role = 'user'""", "v_calls")
# Recorded calls: those of even id hold a diff, of odd id a plan.
cte("recorded", """
SELECT call_id, prompt, CASE WHEN call_id % 2 = 0 THEN 'diff --git a/p b/p' || chr(10) || response
                             ELSE '{"relevant_files": ["f' || CAST(call_id AS VARCHAR) || '.py"]}' END AS response
FROM v_calls""", "v_calls")
cte("replayed", """
SELECT c.call_id, f.response FROM v_calls c
JOIN (SELECT prompt, arg_min(response, call_id) AS response FROM recorded GROUP BY prompt) f USING (prompt)""", "v_calls", "recorded")
oracle("e1_respond", """
SELECT call_id, CASE WHEN starts_with(response, 'diff ') THEN response ELSE '' END AS response FROM replayed""", "replayed")
oracle("e1_structured", """
SELECT call_id, NOT starts_with(response, 'diff ') AS parsed_ok,
       CASE WHEN starts_with(response, 'diff ') THEN 'all.py' ELSE json_extract_string(response, '$.relevant_files[0]') END AS relevant_files
FROM replayed""", "replayed")

oracle("e1_respond_cached", """
SELECT conv_id, turn, coalesce(CAST(length(text) AS VARCHAR) || ':' || substr(text, 1, 20), '') AS response
FROM conversations WHERE role = 'user'""")

# -- sources -----------------------------------------------------------------
oracle("s1_read_issues", "SELECT issue_id, body || chr(10) AS body FROM v_issues", "v_issues")
INT_WS = WS.replace(r"\x1C-\x1F", "")
PY_INT_SQL = f"^[{INT_WS}]*[+-]?[0-9]+(_[0-9]+)*[{INT_WS}]*$"
oracle("s2_resolve_refs", f"""
WITH refs AS (
  SELECT issue_id AS ref_id, repo,
         CASE issue_id % 8 WHEN 0 THEN CAST(number AS VARCHAR) WHEN 1 THEN ' ' || CAST(number AS VARCHAR) || ' '
              WHEN 2 THEN '+' || CAST(number AS VARCHAR) WHEN 3 THEN '-' || CAST(number AS VARCHAR)
              WHEN 4 THEN CAST(number AS VARCHAR) || '_0'
              WHEN 5 THEN CASE WHEN issue_id % 16 = 5 THEN 'notes/' || CAST(number AS VARCHAR) || '.md'
                               ELSE 'see issue ' || CAST(number AS VARCHAR) END
              WHEN 6 THEN '   ' ELSE '0x' || CAST(number AS VARCHAR) END AS ref
  FROM v_issues),
files AS (SELECT 'notes/' || CAST(issue_id AS VARCHAR) || '.md' AS path,
                 CASE WHEN issue_id % 3 = 0 THEN CAST(issue_id AS VARCHAR) ELSE 'Note ' || CAST(issue_id AS VARCHAR) END AS content
          FROM v_issues WHERE issue_id % 32 = 5),
p AS (SELECT *, CASE WHEN regexp_matches(val, '{PY_INT_SQL}')
                     THEN TRY_CAST(regexp_replace(val, '[{INT_WS}]|_', '', 'g') AS BIGINT) END AS n,
             {py_strip_sql('ref')} = '' AS blank
      FROM (SELECT refs.*, coalesce(content, ref) AS val, path IS NOT NULL AS is_file FROM refs LEFT JOIN files ON path = ref)),
k AS (SELECT *, CASE WHEN blank OR n <= 0 THEN 'rejected' WHEN n IS NOT NULL THEN 'number' WHEN is_file THEN 'file'
                     ELSE 'text' END AS k0,
             CASE WHEN blank THEN 'empty reference' WHEN n <= 0 THEN 'issue number must be > 0' END AS r0 FROM p),
j AS (SELECT k.*, i.body AS ibody, i.state AS istate, i.number AS inum
      FROM k LEFT JOIN v_issues i ON i.repo = k.repo AND i.number = (CASE WHEN k.k0 = 'number' THEN k.n END)),
r AS (SELECT *, CASE WHEN k0 = 'number' THEN
                  CASE WHEN inum IS NULL THEN 'issue ' || CAST(n AS VARCHAR) || ': unknown'
                       WHEN coalesce(ibody, '') = '' THEN 'issue ' || CAST(n AS VARCHAR) || ': empty body'
                       WHEN lower(istate) <> 'open' THEN 'issue ' || CAST(n AS VARCHAR) || ': state is not open' END
                  ELSE r0 END AS reason FROM j)
SELECT ref_id, repo, ref, CASE WHEN reason IS NOT NULL THEN 'rejected' ELSE k0 END AS kind,
       CASE WHEN k0 = 'number' THEN n END AS number,
       CASE WHEN k0 = 'number' AND reason IS NULL THEN {markdown_sql('ibody')}
            WHEN k0 IN ('file', 'text') THEN val END AS body,
       reason
FROM r""", "v_issues")

FENCED = """CASE WHEN c.turn % 4 = 1 THEN '```python' || chr(10) || c.text || chr(10) || '```'
                 WHEN c.turn % 4 = 3 THEN '  ```' || chr(10) || c.text || chr(10) || '```  ' || chr(10)
                 ELSE c.text END"""
CLEAN = py_strip_sql("regexp_replace(" + py_strip_sql("response") + ", '(?m)^```[a-zA-Z]*[" + WS +
                     "]*|```$', '', 'g')")
oracle("s9_apply_updates", f"""
WITH upd AS (SELECT f.repo, f.path, c.conv_id * 1000 + c.turn AS seq, {FENCED} AS response
             FROM conversations c JOIN v_repo_files f ON f.file_id = c.conv_id WHERE c.role = 'assistant'),
cl AS (SELECT repo, path, seq, {CLEAN} AS new FROM upd),
lst AS (SELECT repo, path, arg_max(new, seq) AS new FROM cl WHERE new <> '' GROUP BY repo, path)
SELECT coalesce(s.repo, l.repo) AS repo, coalesce(s.path, l.path) AS path,
       coalesce(regexp_replace(l.new, '[{WS}]+\\z', '', 'g') || chr(10), s.content) AS content,
       CASE WHEN l.new IS NULL THEN 'unchanged' WHEN s.content IS NULL THEN 'created' ELSE 'updated' END AS status
FROM snapshot s FULL OUTER JOIN lst l ON s.repo = l.repo AND s.path = l.path""", "snapshot", "v_repo_files")

oracle("s9_file_versions", f"""
WITH upd AS (SELECT f.repo, f.path, c.turn::BIGINT AS version, c.conv_id AS seq, {FENCED} AS response
             FROM conversations c JOIN v_repo_files f ON f.file_id = c.conv_id WHERE c.role = 'assistant'),
cl AS (SELECT repo, path, version, seq, {CLEAN} AS new FROM upd),
lst AS (SELECT repo, path, version, regexp_replace(arg_max(new, seq), '[{WS}]+\\z', '', 'g') || chr(10) AS new
        FROM cl WHERE new <> '' GROUP BY repo, path, version),
ask AS (SELECT DISTINCT repo, path, unnest([0, 2, 5])::BIGINT AS version FROM v_repo_files)
SELECT a.repo, a.path, a.version, l.version AS content_version, coalesce(l.new, s.content) AS content
FROM ask a ASOF LEFT JOIN lst l ON a.repo = l.repo AND a.path = l.path AND a.version >= l.version
LEFT JOIN snapshot s ON s.repo = a.repo AND s.path = a.path""", "v_repo_files", "snapshot")

# -- streams -----------------------------------------------------------------
oracle("x1_stream_run_log", """
SELECT source_file, ts_ms, level, split_part(message, chr(10), 1) AS message,
       nullif(regexp_extract(message, '^=+ starting ([A-Za-z_]+) phase =+$', 1), '') AS phase,
       starts_with(message, 'Tests did not pass. Retrying') AS is_retry,
       message = 'Workflow completed successfully!' AS is_completion
FROM log_printed""", "log_printed")
oracle("x1_stream_whole_records", "SELECT source_file, line_no, ts_ms, level, message FROM log_parsed", "log_parsed")
oracle("x2_stream_retry_ledger", """
SELECT run_id, event_id, attempt, decision, lag(errors) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS carried_errors
FROM ledger""", "ledger")

oracle("x2_expiring_ledger", """
WITH l AS (SELECT run_id, event_id, attempt, decision, errors, ts,
                  lag(errors) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS carried_errors FROM ledger)
SELECT run_id, event_id, attempt, decision, carried_errors FROM l
UNION ALL
SELECT run_id, NULL, max(attempt) + 1, 'expired', arg_max(struct_pack(e := errors), attempt).e FROM l
GROUP BY run_id HAVING bool_and(decision = 'retry')""", "ledger")

# -- semantic retrieval ------------------------------------------------------
SIMILARITY = """round(list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))), 9)"""
cte("vectors", "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings")
oracle("r1_semantic_topk", f"""
SELECT query_id, rank, vec_id, round(s, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM (
    SELECT q.id AS query_id, c.id AS vec_id, {SIMILARITY} AS s FROM vectors q JOIN vectors c ON q.id <> c.id WHERE q.id % 50 = 0))
WHERE rank <= 10""", "vectors")
cte("ranked_files", f"""
SELECT query_id // 50 AS issue_id, repo, path, rank, s AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM (
    SELECT q.id AS query_id, c.id, {SIMILARITY} AS s FROM vectors q JOIN vectors c ON q.id <> c.id
    WHERE q.id % 50 = 0 AND {repo_of('(q.id // 50)')} = {repo_of('c.id')}))
JOIN v_repo_files ON file_id = id WHERE rank <= 5""", "vectors", "v_repo_files")
oracle("r2_hybrid_candidates", """
WITH every AS (
  SELECT issue_id, repo, path, rank, similarity, 's' AS tag FROM ranked_files
  UNION ALL SELECT issue_id, repo, path, NULL, NULL, 'k' FROM mentions
  UNION ALL SELECT issue_id, repo, path, NULL, NULL, 'f' FROM matches m
    WHERE NOT EXISTS (SELECT 1 FROM ranked_files r WHERE r.issue_id = m.issue_id AND r.repo = m.repo)),
merged AS (
  SELECT issue_id, repo, path, min(rank) AS rank, round(max(similarity), 6) AS similarity,
         CASE WHEN bool_or(tag = 's') AND bool_or(tag = 'k') THEN 'both' WHEN bool_or(tag = 's') THEN 'semantic'
              WHEN bool_or(tag = 'k') THEN 'keyword' ELSE 'fallback' END AS source
  FROM every GROUP BY issue_id, repo, path)
SELECT *, row_number() OVER (PARTITION BY issue_id, repo ORDER BY
  CASE source WHEN 'both' THEN 0 WHEN 'semantic' THEN 1 WHEN 'keyword' THEN 2 ELSE 3 END, rank NULLS LAST, path) AS position
FROM merged""", "ranked_files", "mentions", "matches")

# -- remaining inventory items -----------------------------------------------
oracle("a2_plan_sizes", """
SELECT run_id, len(source_files) AS n_source, len(test_files) AS n_test, is_test_generation_issue FROM plans""",
       "plans")
oracle("j6_lookup_issues", """
SELECT r.issue_id AS ref_id, r.issue_id * 2 AS number, i.number IS NOT NULL AS found, i.state
FROM v_issues r LEFT JOIN v_issues i ON i.repo = r.repo AND i.number = r.issue_id * 2""", "v_issues")
oracle("w5_first_seen", """
SELECT run_id, file, event_id AS first_event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, file ORDER BY ts, event_id) AS rn FROM change_events)
WHERE rn = 1""", "change_events")
