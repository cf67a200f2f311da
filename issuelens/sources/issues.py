"""Issue sources: issue files (S1) and issue references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import py_int, py_strip
from ..operators.textops import issue_reason, strip_markdown


#: In packed files every body ends with the record separator; where a body holds
#: one, the escape sign or a byte order mark, that is written as two signs.
RECORD_END = "\x1e"
ESCAPED = {"\x10": "\x10P", RECORD_END: "\x10R", "\ufeff": "\x10B"}


def write_packed_issues(bodies: DataFrame, path: str) -> None:
    """Writes the bodies (one column; null: empty) into wide files, one per
    task, for :func:`read_issues`."""
    body = F.coalesce(F.col(bodies.columns[0]), F.lit(""))
    for sign, pair in ESCAPED.items():
        body = F.replace(body, F.lit(sign), F.lit(pair))
    bodies.select(body.alias("value")).write.option("lineSep", RECORD_END).text(path)


def read_issues(spark: SparkSession, path: str, glob: str | None = None, packed: bool = False) -> DataFrame:
    """One file = one issue body (UTF-8, whole text) with its path.

    A file, a listing and a task's share per issue do not scale, so issues may
    also come ``packed``: many whole bodies in one file, as
    :func:`write_packed_issues` has them; such files are split over tasks.
    """
    r = spark.read
    if glob:
        r = r.option("pathGlobFilter", glob)
    body = F.col("value")
    if packed:
        r = r.text(path, lineSep=RECORD_END)
        for sign, pair in reversed(ESCAPED.items()):
            body = F.replace(body, F.lit(pair), F.lit(sign))
    else:
        r = r.text(path, wholetext=True)
    return r.select(F.col("_metadata.file_path").alias("issue_file"), body.alias("body"))


def lookup_issues(refs: DataFrame, issues: DataFrame) -> DataFrame:
    """Issue number → issue row of the same repository (left join;
    unmatched rows keep NULL ``_body``/``_state``)."""
    i = issues.select(F.col("repo").alias("_irepo"), F.col("number").alias("_num"), F.col("body").alias("_body"),
                      F.col("state").alias("_state"))
    return refs.join(i, (F.col("repo") == F.col("_irepo")) & (F.col("number") == F.col("_num")), "left") \
        .drop("_irepo")


def resolve_issue_refs(refs: DataFrame, issues: DataFrame, files: DataFrame | None = None,
                       ref_col: str = "ref") -> DataFrame:
    """Classify each reference string and resolve it to an issue body.

    Order of the checks: blank → rejected; names a file (``files``:
    ``path, content``) → its content; parses as ``int()`` → a number, which
    must be > 0 and is looked up (J6), then must have a body and be open
    (F6) and is stripped of markdown (F7); anything else is literal text.
    Columns added: ``kind`` (file/number/text/rejected), ``number``,
    ``body``, ``reason``.
    """
    r = refs
    if files is not None:
        f = files.select(F.col("path").alias("_fpath"), F.col("content").alias("_fcontent"))
        r = r.join(f, F.col(ref_col) == F.col("_fpath"), "left")
    else:
        r = r.withColumn("_fpath", F.lit(None).cast("string")).withColumn("_fcontent", F.lit(None).cast("string"))
    blank = py_strip(F.coalesce(F.col(ref_col), F.lit(""))) == ""
    is_file = F.col("_fpath").isNotNull()
    value = F.when(is_file, F.col("_fcontent")).otherwise(F.col(ref_col))
    n = py_int(value)
    kind = (F.when(blank, "rejected").when(n.isNotNull() & (n <= 0), "rejected")
            .when(n.isNotNull(), "number").when(is_file, "file").otherwise("text"))
    reason = F.when(blank, "empty reference").when(n.isNotNull() & (n <= 0), "issue number must be > 0")
    r = (r.withColumn("_value", value).withColumn("kind", kind).withColumn("reason", reason)
         .withColumn("number", F.when(F.col("kind") == "number", n)))
    looked = lookup_issues(r, issues)
    num_reason = F.when(F.col("_num").isNull(), F.concat(F.lit("issue "), F.col("number").cast("string"), F.lit(": unknown"))) \
        .otherwise(issue_reason(F.col("_body"), F.col("_state"), F.col("number")))
    is_num = F.col("kind") == "number"
    final_reason = F.when(is_num, num_reason).otherwise(F.col("reason"))
    body = (F.when(is_num & final_reason.isNull(), strip_markdown(F.col("_body")))
            .when(F.col("kind").isin("file", "text"), F.col("_value")))
    out_kind = F.when(final_reason.isNotNull(), "rejected").otherwise(F.col("kind"))
    return looked.select(*refs.columns, out_kind.alias("kind"), "number", body.alias("body"),
                         final_reason.alias("reason"))
