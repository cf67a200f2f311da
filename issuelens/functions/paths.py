"""POSIX path parts with the semantics of ``pathlib.PurePosixPath``.

* name   – last segment
* suffix – from the last dot of the name, provided the dot is neither the
  first nor the last character of the name (``.py`` has no suffix and is
  its own stem)
* stem   – name without the suffix
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def file_name(path) -> Column:
    return F.regexp_extract(_c(path), r"([^/]*)$", 1)


def file_suffix(path) -> Column:
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def file_stem(path) -> Column:
    name = file_name(path)
    return F.when(file_suffix(path) == "", name).otherwise(
        F.regexp_extract(name, r"^(.+)\.[^.]+$", 1))


def parent_dir(path) -> Column:
    """Directory part; ``""`` for a bare name (Python gives ``.``)."""
    return F.regexp_extract(_c(path), r"^(.*)/[^/]*$", 1)
