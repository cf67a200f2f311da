"""Issue-to-file retrieval: mentions, test-file matching, candidate sets.

Shuffle plan of the flagship (``candidate_files``):

* ``mentions``      – narrow (regex + explode per issue row), written once
* ``match_tests``   – one equi-join on ``(repo, key)``: every test-like file
  name is indexed by its substrings of the lengths that occur and that pass a
  Bloom filter of the stems, so "name contains stem" is an exact equality
  lookup.  No pair of (mention, file) is ever enumerated, and
  a repository holding a third of all files spreads over as many join keys
  as its file names have substrings instead of landing in one task.  The
  join is left outer, so each mention row carries its own matches and the
  regex pass over the issue bodies happens once.
* distinct          – one shuffle on ``(issue_id, repo, path)`` with
  map-side partial distinct.
* fallback          – issues without any mention (the outer generate's rows
  without a path) equi-joined on ``repo`` with the inventory; it emits
  exactly the result rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bloom import bloom_filter, may_hold
from ..functions.paths import file_name, file_stem, file_suffix
from ..functions.text import array_size
from ..session import ensure_checkpoint_dir

# The mention pattern (lazy, alternation order and missing end
# boundary kept, so ``x.json`` is read as ``x.js``) and the suffixes of the
# file walk.
MENTION_PATTERN = r"[a-zA-Z0-9_\-/\\]+?\.(?:py|js|ts|tsx|jsx|json)"
SOURCE_SUFFIXES = [".py", ".js", ".ts", ".jsx", ".tsx", ".json"]
TEST_MARKERS = ["test", "spec"]

# The same matches, found faster.  Every start inside one run of pattern
# characters reaches the same run end, so it matches exactly when the run's
# first character does; a reported match therefore starts either at a run
# start or where the previous match ended.  Saying so up front lets the
# engine reject every other start position in O(1).  (The SQL oracle and the
# randomized test use the plain pattern, which checks the equivalence.)
MENTION_SCAN_PATTERN = r"(?:(?<![a-zA-Z0-9_\-/\\])|\G)" + MENTION_PATTERN


def _slash(c):
    return F.translate(c, "\\", "/")


def repo_file_inventory(files: DataFrame) -> DataFrame:
    """S3: the set of (repo, path) with a source suffix, ``\\`` → ``/``.

    When ``content`` is present one content per path is kept (the least, so
    the choice is deterministic for duplicated paths).
    """
    f = files.withColumn("path", _slash(F.col("path"))).filter(file_suffix("path").isin(SOURCE_SUFFIXES))
    if "content" in files.columns:
        return f.groupBy("repo", "path").agg(F.min("content").alias("content"))
    return f.select("repo", "path").distinct()


def is_test_name(path) -> "F.Column":
    name = F.lower(file_name(path))
    return name.contains(TEST_MARKERS[0]) | name.contains(TEST_MARKERS[1])


def with_test_flag(files: DataFrame, path_col: str = "path") -> DataFrame:
    """``is_test`` = lower-case file name contains ``test`` or ``spec``."""
    return files.withColumn("is_test", is_test_name(F.col(path_col)))


def _found(body_col: str) -> "F.Column":
    return F.array_distinct(F.transform(F.regexp_extract_all(F.col(body_col), F.lit(MENTION_SCAN_PATTERN), 0), _slash))


def mentions(issues: DataFrame, body_col: str = "body", keys=("issue_id", "repo")) -> DataFrame:
    """F8: distinct file mentions of each issue body, one row each."""
    return issues.select(*keys, F.explode(_found(body_col)).alias("path"))


def _substrings(s, lengths=None) -> "F.Column":
    """Distinct substrings of a string, of the given lengths or of all."""
    n = F.char_length(s)
    lengths = F.sequence(F.lit(1), n) if lengths is None else F.filter(lengths, lambda x: x <= n)
    return F.array_distinct(F.flatten(F.transform(
        lengths, lambda x: F.transform(F.sequence(F.lit(1), n - x + 1), lambda i: F.substring(s, i, x)))))


# A stem comes from the mention pattern, so once lower-cased it only holds
# these characters; substrings of a name that hold any other can never equal
# a stem.
STEM_CHARS_RUN = "[a-z0-9_-]+"


#: Bits of the stem filter: 4 MB however many stems there are.
FILTER_BITS = 1 << 25


def stem_filter(stems: DataFrame) -> DataFrame:
    """A Bloom filter of the (repo, key) rows."""
    return bloom_filter(stems, ("repo", "key"), FILTER_BITS)


def test_index(inventory: DataFrame, stems: DataFrame | None = None) -> DataFrame:
    """Test-like files keyed by the distinct substrings of their lower-case
    name that could equal a stem: ``(repo, key, path)``.

    With ``stems`` (``repo, key`` of the mentions, evaluated twice) only
    substrings of the lengths that the repository's stems have are made, and
    of these only such that pass a Bloom filter of the stems, before any
    shuffle of the index.  Without, all substrings: quadratic in the length of
    a name's longest run of stem characters."""
    tests = (inventory.select("repo", "path").filter(is_test_name("path"))
             .withColumn("name_lc", F.lower(file_name("path"))))
    runs = F.regexp_extract_all(F.col("name_lc"), F.lit(STEM_CHARS_RUN), 0)
    if stems is None:
        keys = F.transform(runs, lambda r: _substrings(r))
    else:
        lengths = stems.groupBy("repo").agg(F.collect_set(F.char_length("key")).alias("_lengths"))
        tests = tests.join(lengths, "repo")
        keys = F.transform(runs, lambda r: _substrings(r, F.filter("_lengths", lambda n: n > 0)))
    index = tests.select("repo", F.explode(F.array_distinct(F.flatten(keys))).alias("key"), "path")
    return index if stems is None else may_hold(index, stem_filter(stems), ("repo", "key"), FILTER_BITS)


def _keyed(mention_rows: DataFrame) -> DataFrame:
    return mention_rows.withColumn("key", F.lower(file_stem("path")))


def _written(rows: DataFrame) -> DataFrame:
    """Mention rows in the shared folder: the text is scanned once, and the
    lengths, the filter and the join read the rows."""
    ensure_checkpoint_dir(rows.sparkSession)
    return rows.checkpoint()


def match_tests(mention_rows: DataFrame, inventory: DataFrame) -> DataFrame:
    """Test-like files of the same repo whose lower-case name contains
    the lower-case stem of a mention.  Empty stems match nothing (the index
    holds no empty key).  Mentions are those of :func:`mentions` (F8), so
    a stem holds only ASCII letters, digits, ``_`` and ``-``; file names may
    hold anything.

    Returns ``(issue_id, repo, mention, path)``.
    """
    m = _written(_keyed(mention_rows).select("issue_id", "repo", F.col("path").alias("mention"), "key"))
    return m.join(test_index(inventory, m.select("repo", "key")), ["repo", "key"]).select("issue_id", "repo", "mention", "path")


def candidate_files(issues: DataFrame, inventory: DataFrame, fallback_all: bool = True,
                    body_col: str = "body", dedupe: bool = True) -> DataFrame:
    """A1 (+U1): per issue, distinct mentions ∪ matched test files.

    Mentions need not exist in the repository.  With ``fallback_all`` (the
    modular behaviour) an issue with no candidate gets every inventory file
    of its repository.  Long form ``(issue_id, repo, path)``; use
    :func:`candidate_lists` for the sorted array per issue.

    One pass over the bodies: an outer generate gives a row per mention, or
    one row without a path, which is the fallback's key (a NULL body falls
    back as well).  Each mention row is left-joined to the test index and both
    the mention and its matched test are emitted from that one row.
    ``dedupe=False`` leaves duplicate rows for a caller that aggregates per
    issue anyway (saves one shuffle).
    """
    inv = inventory.select("repo", "path")
    rows = _written(_keyed(issues.select("issue_id", "repo", F.explode_outer(_found(body_col)).alias("path"))))
    m = rows.filter("path IS NOT NULL")
    j = m.join(test_index(inv, m.select("repo", "key")).withColumnRenamed("path", "test_path"), ["repo", "key"], "left")
    cands = j.select("issue_id", "repo", F.explode(F.array_compact(F.array("path", "test_path"))).alias("path"))
    if dedupe:
        cands = cands.distinct()
    if not fallback_all:
        return cands
    empty = rows.filter("path IS NULL").select("issue_id", "repo")
    return cands.unionByName(empty.join(inv, "repo").select("issue_id", "repo", "path"))


def candidate_lists(cands: DataFrame) -> DataFrame:
    """Candidates as one array per issue, sorted by code point."""
    return cands.groupBy("issue_id", "repo").agg(F.sort_array(F.collect_set("path")).alias("candidates"))


def plan_sizes(plans: DataFrame) -> DataFrame:
    """A2: number of source and test files of each plan, and its flag."""
    return plans.select(
        "run_id",
        F.coalesce(array_size("source_files"), F.lit(0)).cast("bigint").alias("n_source"),
        F.coalesce(array_size("test_files"), F.lit(0)).cast("bigint").alias("n_test"),
        F.coalesce("is_test_generation_issue", F.lit(False)).alias("is_test_generation_issue"))
