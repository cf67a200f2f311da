"""String helpers with Python ``str`` semantics, as Catalyst expressions.

Every regular expression here stays in the subset shared by Java regex and
RE2 (no look-around, no inline ``(?U)``), so the same pattern can be used by
the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.isspace`` accepts, which
# ``str.strip()``/``str.split()``/``int()`` treat as whitespace.
PY_WS_CLASS = (r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
               r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
PY_WS = f"[{PY_WS_CLASS}]"
# The same characters as a plain string (for trim functions).
PY_WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
               + "\u2028\u2029\u202f\u205f\u3000")
PY_NON_WS_RUN = f"[^{PY_WS_CLASS}]+"

# ``int(s)`` accepts surrounding whitespace, one sign and single underscores
# between digit groups.  Its whitespace is narrower than ``str.split``'s:
# the ASCII separators \x1C-\x1F do not count.
PY_INT_WS = (r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
             r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
PY_INT_PATTERN = rf"^{PY_INT_WS}*[+-]?[0-9]+(_[0-9]+)*{PY_INT_WS}*$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """``str.strip()`` (all Python whitespace, both ends).  ``trim`` with a
    character set only looks at the ends, unlike a regex that is tried at
    every whitespace position."""
    return F.trim(_c(col), F.lit(PY_WS_CHARS))


def py_rstrip(col) -> Column:
    return F.rtrim(_c(col), F.lit(PY_WS_CHARS))


def py_lstrip(col) -> Column:
    return F.ltrim(_c(col), F.lit(PY_WS_CHARS))


def py_int(col) -> Column:
    """``int(s)`` for strings it accepts, else NULL (ASCII digits)."""
    c = _c(col)
    digits = F.regexp_replace(c, rf"{PY_INT_WS}|_", "")
    return F.when(c.rlike(PY_INT_PATTERN), digits.try_cast("bigint"))


def py_split_count(col) -> Column:
    """``len(s.split())`` – number of whitespace-separated tokens.

    Computed as the pieces of a split on whitespace runs, minus the empty
    piece a leading or trailing run leaves; a positive character class is
    several times faster in Java's regex engine than the negated one.
    """
    c = _c(col)
    pieces = F.size(F.split(c, f"{PY_WS}+"))
    lead = F.substring(c, 1, 1).rlike(f"^{PY_WS}$").cast("int")
    trail = F.substring(c, -1, 1).rlike(f"^{PY_WS}$").cast("int")
    return F.when(c == "", F.lit(0)).otherwise(pieces - lead - trail).cast("bigint")


def py_list_repr(arr) -> Column:
    """``str(list_of_str)``: ``['a', 'b']``; backslashes and line ends escaped,
    double quotes around a string that holds single quotes only."""
    def one(x):
        esc = x
        for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            esc = F.replace(esc, F.lit(raw), F.lit(shown))
        return F.when(x.contains("'") & ~x.contains('"'), F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(
            F.concat(F.lit("'"), F.replace(esc, F.lit("'"), F.lit("\\'")), F.lit("'")))
    return F.concat(F.lit("["), F.array_join(F.transform(_c(arr), one), ", "), F.lit("]"))


def array_size(arr) -> Column:
    """Number of elements; NULL for a NULL array whatever
    ``spark.sql.ansi.enabled`` says (without it ``size(NULL)`` is -1)."""
    c = _c(arr)
    return F.when(c.isNotNull(), F.size(c))
