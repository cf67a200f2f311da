"""Plans: parsing model output, file lists, test-file fallbacks, work lists.

``plans``: ``run_id, repo, relevant_files, source_files, test_files,
is_test_generation_issue`` (+ ``language_ctx`` where the project context
names a language).  Per-repository facts (test directory, pytest config)
are small aggregates joined back on ``repo``; file existence is a semi/anti
join on ``(repo, path)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import file_stem, file_suffix
from ..functions.json import STRICT, strict_json
from ..functions.text import py_strip
from .retrieval import is_test_name
from .runs import ordered_pieces

def _empty() -> Column:
    return F.array().cast("array<string>")


def _arr(c: str) -> Column:
    return F.coalesce(F.col(c), _empty())


def lint_targets(plans: DataFrame) -> DataFrame:
    """relevant files ending in ``.py`` whose lower-case stem lacks
    ``test``; one row each, plan order kept in ``pos``."""
    x = plans.select("run_id", F.posexplode(_arr("relevant_files")).alias("pos", "path"))
    return x.filter(F.col("path").endswith(".py") & ~F.lower(file_stem("path")).contains("test"))


def test_dirs(repo_files: DataFrame) -> DataFrame:
    """Per repository: ``tests`` if a ``tests/`` directory exists, else
    ``test`` if ``test/`` does, else ``tests`` (the one that would be made)."""
    p = F.col("path")
    return repo_files.groupBy("repo").agg(
        F.bool_or(p.startswith("tests/")).alias("_has_tests"),
        F.bool_or(p.startswith("test/")).alias("_has_test")
    ).select("repo", F.when(F.col("_has_tests"), "tests").when(F.col("_has_test"), "test")
             .otherwise("tests").alias("test_dir"))


def normalize_test_paths(plans: DataFrame, repo_files: DataFrame, col: str = "test_files") -> DataFrame:
    """a bare file name goes under the repository's test directory;
    paths with a directory are kept."""
    j = plans.join(test_dirs(repo_files), "repo", "left")
    td = F.coalesce(F.col("test_dir"), F.lit("tests"))
    # ``./x.py`` has no directory of its own either.
    bare = F.regexp_replace
    fixed = F.transform(_arr(col), lambda p: F.when(bare(p, r"^(\./+)+", "").contains("/"), p)
                        .otherwise(F.concat(td, F.lit("/"), bare(p, r"^(\./+)+", ""))))
    return j.withColumn(col, fixed).drop("test_dir")


def commit_path(col) -> Column:
    """commit paths use ``/`` and no leading ``/``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.translate(c, "\\", "/"), "^/+", "")


def _lang_of_suffix(s: Column) -> Column:
    s = F.lower(s)
    return (F.when(s == ".py", "python").when(s.isin(".ts", ".tsx"), "typescript")
            .when(s.isin(".js", ".jsx"), "javascript"))


def language_of(ctx: Column, files: Column) -> Column:
    """from the context language (``python``; ``typescript``/``ts``;
    ``javascript``/``js`` as substrings, in that order), else the first
    relevant file with a known suffix, else ``python``.  A NULL context
    counts as none."""
    t = F.lower(ctx)
    first = F.try_element_at(F.filter(files, lambda f: _lang_of_suffix(file_suffix(f)).isNotNull()), F.lit(1))
    return (F.when(t.contains("python"), "python")
            .when(t.contains("typescript") | t.contains("ts"), "typescript")
            .when(t.contains("javascript") | t.contains("js"), "javascript")
            .otherwise(F.coalesce(_lang_of_suffix(file_suffix(first)), F.lit("python"))))


def with_language(df: DataFrame, ctx_col: str = "language_ctx", files_col: str = "relevant_files") -> DataFrame:
    return df.withColumn("language", language_of(F.col(ctx_col), _arr(files_col)))


def inferred_test_file(language: Column, source_files: Column) -> Column:
    """test file name for a plan that lists none."""
    first = F.try_element_at(source_files, F.lit(1))
    base = F.regexp_replace(file_stem(first), "^test_", "")
    named = (F.when(language == "python", F.concat(F.lit("test_"), base, F.lit(".py")))
             .when(language == "typescript", F.concat(base, F.lit(".test.ts")))
             .otherwise(F.concat(base, F.lit(".test.js"))))
    generic = F.when(language == "python", F.lit("test_generated.py")).otherwise(F.lit("generated.test.ts"))
    return F.when(F.size(source_files) > 0, named).otherwise(generic)


def infer_test_files(plans: DataFrame) -> DataFrame:
    """fill empty ``test_files`` with the inferred name (bare; F11
    places it).  Needs ``language`` (F12)."""
    t = _arr("test_files")
    return plans.withColumn("test_files", F.when(F.size(t) == 0, F.array(
        inferred_test_file(F.col("language"), _arr("source_files")))).otherwise(t))


PLAN_SCHEMA = T.StructType([
    T.StructField("relevant_files", T.ArrayType(T.StringType())),
    T.StructField("source_files", T.ArrayType(T.StringType())),
    T.StructField("test_files", T.ArrayType(T.StringType())),
    T.StructField("is_test_generation_issue", T.BooleanType()),
    T.StructField("_corrupt", T.StringType()),
])


def parse_plans(responses: DataFrame, response_col: str = "response",
                candidates_col: str = "candidates") -> DataFrame:
    """exactly one valid JSON object → its fields, absent keys ``[]``/false; empty
    text or a parse failure (incl. a wrong-typed field) → relevant = source =
    all candidates, tests ``[]``, flag false.  ``parsed_ok`` tells which."""
    p = F.from_json(strict_json(response_col), PLAN_SCHEMA,
                    {**STRICT, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    x = responses.withColumn("_p", p)
    ok = F.col("_p").isNotNull() & F.col("_p._corrupt").isNull()
    cand = _arr(candidates_col)
    get = lambda f: F.coalesce(F.col(f"_p.{f}"), _empty())
    return x.select(
        *[c for c in responses.columns if c != response_col],
        ok.alias("parsed_ok"),
        F.when(ok, get("relevant_files")).otherwise(cand).alias("relevant_files"),
        F.when(ok, get("source_files")).otherwise(cand).alias("source_files"),
        F.when(ok, get("test_files")).otherwise(_empty()).alias("test_files"),
        F.when(ok, F.coalesce(F.col("_p.is_test_generation_issue"), F.lit(False))).otherwise(False)
         .alias("is_test_generation_issue"))


def dependency_list(col) -> Column:
    """a string is split on ``,``, items stripped, empties dropped; an
    array is kept; NULL stays NULL (no dependencies)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.filter(F.transform(F.split(c, ","), lambda x: py_strip(x)), lambda x: x != "")


def existing_tests(tests: DataFrame, repo_files: DataFrame, col: str = "path") -> DataFrame:
    """Planned tests that exist (left semi on ``(repo, path)``)."""
    files = repo_files.select("repo", F.col("path").alias(col))
    return tests.join(files, ["repo", col], "left_semi")


def missing_tests(tests: DataFrame, repo_files: DataFrame, col: str = "path") -> DataFrame:
    """Planned tests that do not exist (left anti)."""
    files = repo_files.select("repo", F.col("path").alias(col))
    return tests.join(files, ["repo", col], "left_anti")


def effective_tests(plans: DataFrame, repo_files: DataFrame) -> DataFrame:
    """The tests a run executes: its planned tests that exist; if none,
    its test-like relevant files that exist; if none, none.  Long form
    ``(run_id, repo, pos, path, stage)``.

    One pass over ``plans``: planned tests and test-like relevant files are
    exploded together, one semi join keeps those that exist, and each run
    keeps the rows of its best stage (a window over at most the files of
    one plan).
    """
    item = lambda rank: (lambda p, i: F.struct(F.lit(rank).alias("rank"), i.alias("pos"), p.alias("path")))
    rel = F.filter(F.transform(_arr("relevant_files"), item(1)), lambda x: is_test_name(x["path"]))
    x = plans.select("run_id", "repo", F.explode(F.concat(F.transform(_arr("test_files"), item(0)), rel)).alias("_it")) \
        .select("run_id", "repo", "_it.rank", "_it.pos", "_it.path")
    ex = existing_tests(x, repo_files)
    best = F.min("rank").over(Window.partitionBy("run_id"))
    return ex.withColumn("_best", best).filter(F.col("rank") == F.col("_best")).select(
        "run_id", "repo", F.col("pos").cast("int").alias("pos"), "path",
        F.when(F.col("rank") == 0, "planned").otherwise("relevant").alias("stage"))


# Test commands and the pytest settings that make a bare
# ``pytest`` run.
PYTEST = "pytest"
NPM_TEST = "npm run test"
JS_SUFFIXES = [".js", ".jsx", ".ts", ".tsx"]


def check_worklist(tests: DataFrame, repo_config: DataFrame, variant: str = "modular") -> DataFrame:
    """the command per test file: ``.py`` → ``pytest <path>``, or bare
    ``pytest`` when the repository's ``pyproject.toml`` has both ``addopts``
    and ``--doctest-rst``; JS/TS → ``npm run test``; others skipped.  The
    ``class`` variant has no doctest rule."""
    cfg = repo_config.filter(F.col("path") == "pyproject.toml").groupBy("repo").agg(
        F.bool_or(F.col("content").contains("addopts") & F.col("content").contains("--doctest-rst"))
        .alias("_doctest"))
    sfx = F.lower(file_suffix("path"))
    doctest = F.coalesce("_doctest", F.lit(False)) & F.lit(variant != "class")
    cmd = (F.when(sfx == ".py", F.when(doctest, F.lit(PYTEST))
                  .otherwise(F.concat(F.lit(PYTEST + " "), F.col("path"))))
           .when(sfx.isin(JS_SUFFIXES), F.lit(NPM_TEST)))
    return tests.join(cfg, "repo", "left").withColumn("command", cmd).filter(F.col("command").isNotNull()) \
        .drop("_doctest")


def route(plans: DataFrame) -> DataFrame:
    """``test_generation`` when flagged and tests are listed;
    ``code_generation`` when not flagged and sources are listed; else
    ``none``.  Never both."""
    flag = F.coalesce(F.col("is_test_generation_issue"), F.lit(False))
    return plans.withColumn(
        "branch", F.when(flag & (F.size(_arr("test_files")) > 0), "test_generation")
        .when(~flag & (F.size(_arr("source_files")) > 0), "code_generation").otherwise("none"))


def attach_content(targets: DataFrame, snapshot: DataFrame, col: str = "path") -> DataFrame:
    """Current content of each target file; a missing file reads as
    ``""``."""
    s = snapshot.select("repo", F.col("path").alias(col), "content")
    return targets.join(s, ["repo", col], "left").withColumn("content", F.coalesce("content", F.lit("")))


def change_summaries(changes: DataFrame, snapshot: DataFrame, n: int = 500) -> DataFrame:
    """Per run, ``path:\\n<first n chars>`` of every changed file that
    exists, joined by a blank line (path order); missing files dropped."""
    rows = changes.select("run_id", "repo", F.explode(_arr("changed_files")).alias("path"))
    j = rows.join(snapshot.select("repo", "path", "content"), ["repo", "path"])
    item = F.struct("path", F.concat("path", F.lit(":\n"), F.substring("content", 1, n)).alias("t"))
    return j.groupBy("run_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["t"]), "\n\n").alias("summary"))


def summary_pieces(changes: DataFrame, snapshot: DataFrame, n: int = 500, rows: int = 20_000) -> DataFrame:
    """J5 in long form: ``(run_id, piece, offset, text)``, one row per changed
    file that exists; joined by a blank line they are the summary."""
    touched = changes.select("run_id", "repo", F.explode(_arr("changed_files")).alias("path"))
    j = touched.join(snapshot.select("repo", "path", "content"), ["repo", "path"])
    item = j.select("run_id", "path", F.concat("path", F.lit(":\n"), F.substring("content", 1, n)).alias("_t"))
    return ordered_pieces(item.filter("_t IS NOT NULL"), "run_id", ("path", "_t"), "_t", "\n\n", rows)


def repo_snapshot(files: DataFrame) -> DataFrame:
    """All files of each repository (any suffix) with one content per path."""
    return files.withColumn("path", F.translate("path", "\\", "/")).groupBy("repo", "path") \
        .agg(F.min("content").alias("content"))


def plans_from_candidates(cands: DataFrame) -> DataFrame:
    """Heuristic plans: relevant = candidates, source = non-test candidates,
    tests = test-like candidates (each a sorted set, so candidates may hold
    duplicates); not flagged as a test-generation issue."""
    t = is_test_name("path")
    g = cands.groupBy(F.col("issue_id").alias("run_id"), "repo").agg(
        F.sort_array(F.collect_set("path")).alias("relevant_files"),
        F.sort_array(F.collect_set(F.when(~t, F.col("path")))).alias("source_files"),
        F.sort_array(F.collect_set(F.when(t, F.col("path")))).alias("test_files"))
    return g.withColumn("is_test_generation_issue", F.lit(False))

