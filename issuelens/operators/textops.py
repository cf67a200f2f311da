"""Text jobs over issue bodies, model responses and check output.

All of them are column expressions (regex, substring, contains) planned
inside whole-stage code generation; the regular expressions keep Python
semantics where it matters (Python whitespace, ``\\n`` as the only line end
via Java's ``(?d)`` flag).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import file_suffix
from ..functions.text import PY_WS, py_lstrip, py_split_count, py_strip


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def issue_reason(body: Column, state: Column, number: Column) -> Column:
    """Why an issue is rejected: ``issue N: empty body`` / ``issue N: state
    is not open``; NULL when it is fine."""
    head = F.concat(F.lit("issue "), number.cast("string"))
    return F.when(F.coalesce(body, F.lit("")) == "", F.concat(head, F.lit(": empty body"))) \
        .when(F.lower(state) != "open", F.concat(head, F.lit(": state is not open")))


def open_issues(df: DataFrame, body: str = "body", state: str = "state",
                number: str = "number") -> tuple[DataFrame, DataFrame]:
    """``(ok, rejected)``: the body must be non-empty, then the state
    ``open`` (case-insensitive); ``reason`` names the first failed check."""
    reason = issue_reason(F.col(body), F.col(state), F.col(number))
    t = df.withColumn("reason", reason)
    return t.filter(F.col("reason").isNull()).drop("reason"), t.filter(F.col("reason").isNotNull())


# Fenced blocks (an open one reaches the end) and inline code.
CODE_RE = r"(?s)```.*?(?:```|\z)|`[^`\n]+`"
CUT = "\u0001"


def strip_markdown(col) -> Column:
    """markdown → plain text (our own rule set; code is kept).

    The text is cut into code (fenced blocks, inline code) and the rest.
    Fenced blocks stay as they are, inline code loses its ticks only.  In the
    rest, heading markers, bold/italic markers and HTML tags are removed,
    spaces before line ends dropped and runs of blank lines collapsed to one
    line break.  Ends are trimmed.  (U+0001 separates the parts; a text's own
    is dropped.)
    """
    t = F.translate(_c(col), CUT, "")
    parts = F.split(F.regexp_replace(t, CODE_RE, CUT + "$0" + CUT), CUT)

    def part(x, i):
        code = F.when(x.startswith("```"), x).otherwise(F.substring(x, F.lit(2), F.length(x) - 2))
        heading = F.when(i == 0, F.regexp_replace(x, r"(?md)^#{1,6}[ \t]+", "")) \
            .otherwise(F.regexp_replace(x, r"\n#{1,6}[ \t]+", "\n"))
        prose = F.regexp_replace(heading, r"\*\*([^*\n]+)\*\*", "$1")
        prose = F.regexp_replace(prose, r"__([^_\n]+)__", "$1")
        prose = F.regexp_replace(prose, r"<[a-zA-Z/][^<>\n]*>", "")
        prose = F.regexp_replace(prose, r"[ \t]+\n", "\n")
        return F.when(i % 2 == 1, code).otherwise(F.regexp_replace(prose, r"\n{2,}", "\n"))
    return py_strip(F.array_join(F.transform(parts, part), ""))


# Python's re.sub(r"^```[a-zA-Z]*\s*|```$", "", s, flags=re.M): with (?d)
# only "\n" ends a line, as in Python; \s is Python's whitespace.
FENCE_RE = rf"(?md)^```[a-zA-Z]*{PY_WS}*|```$"


def clean_response(col) -> Column:
    """strip, drop code fences at line starts/ends, strip again."""
    return py_strip(F.regexp_replace(py_strip(_c(col)), FENCE_RE, ""))


def diff_only(col) -> Column:
    """the response if its left-stripped text starts with ``diff ``,
    else ``""``."""
    c = _c(col)
    return F.when(py_lstrip(c).startswith("diff "), c).otherwise(F.lit(""))


def with_token_count(df: DataFrame, col: str, out: str = "n_tokens") -> DataFrame:
    """F16: approximate tokens = ``len(text.split())``."""
    return df.withColumn(out, py_split_count(col))


# The phrases of the test-issue heuristic, in their order.
TEST_ISSUE_PHRASES = [
    "test case",
    "test file",
    "add test",
    "write test",
    "unit test",
    "unit tests",
    "integration test",
    "pytest",
    "jest",
    "mocha",
    "add coverage",
    "missing test",
    "missing tests",
]


def test_issue_flag(col) -> Column:
    """lower-case text contains any of the phrases (plain substring
    tests on one lower-cased copy; about twice as fast as a regex
    alternation)."""
    low = F.lower(_c(col))
    return reduce(lambda a, b: a | b, [low.contains(p) for p in TEST_ISSUE_PHRASES])


# The failure markers read from check stderr.
MISSING_MODULE_RE = r"ModuleNotFoundError: No module named '([^']+)'"
BUILD_HINTS = ["pip install -e .", "python setup.py build_ext --inplace"]


def classify_failures(checks: DataFrame, file_col: str = "file", stderr_col: str = "stderr") -> DataFrame:
    """``missing_modules`` (distinct, sorted) for ``.py`` checks whose
    stderr names them, and ``needs_build`` (ImportError plus a build hint)."""
    err = F.coalesce(F.col(stderr_col), F.lit(""))
    is_py = F.lower(file_suffix(F.col(file_col))) == ".py"
    mods = F.when(is_py & err.contains("ModuleNotFoundError") & err.contains("No module named"),
                  F.sort_array(F.array_distinct(F.regexp_extract_all(err, F.lit(MISSING_MODULE_RE), 1))))
    build = is_py & err.contains("ImportError") & (err.contains(BUILD_HINTS[0]) | err.contains(BUILD_HINTS[1]))
    return checks.withColumn("missing_modules", F.coalesce(mods, F.array().cast("array<string>"))) \
        .withColumn("needs_build", build)


def preview(col, n: int) -> Column:
    """the first ``n`` characters (code points)."""
    return F.substring(_c(col), 1, n)
