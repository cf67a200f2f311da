"""Repository URL → ``owner/repo`` key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repo_key(url: Column) -> Column:
    """Modular variant: drop one trailing ``.git``; ``git@…`` → text after
    the first ``:``; ``http(s)://`` → the last two ``/`` parts; anything
    else has no key (NULL)."""
    base = F.regexp_replace(url, r"\.git\z", "")
    parts = F.split(base, "/")
    return (F.when(base.startswith("git@"), F.regexp_replace(base, r"\A[^:]*:", ""))
            .when(base.startswith("https://") | base.startswith("http://"),
                  F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))))


def repo_dir_name(url: Column) -> Column:
    """Class variant: strip trailing ``/``, last segment, drop ``.git``."""
    last = F.element_at(F.split(F.regexp_replace(url, r"/+\z", ""), "/"), -1)
    return F.regexp_replace(last, r"\.git\z", "")


def with_repo_key(df: DataFrame, url_col: str = "url", variant: str = "modular") -> tuple[DataFrame, DataFrame]:
    """``(keyed, rejected)``; rejected rows have no key."""
    key = repo_key(F.col(url_col)) if variant == "modular" else repo_dir_name(F.col(url_col))
    out = df.withColumn("repo_key", key)
    return out.filter(F.col("repo_key").isNotNull()), out.filter(F.col("repo_key").isNull())
