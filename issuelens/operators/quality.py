"""Jobs modelled on the sample target project.

Money and temperatures are rounded in ``decimal(18,6)`` (HALF_UP), which
Spark and the SQL oracle agree on; Python's ``round`` on binary floats can
differ from it by 0.01 on exact ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PY_WS

DEC = "decimal(18,6)"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def reprice(price, pct) -> Column:
    """Price ≤ 0 → 0; negative discount → 0 %; else
    ``price·(1 − pct/100)`` rounded to 2.  Discounts above 100 are not
    capped (as in the reference)."""
    p = _c(price).cast(DEC)
    d = F.greatest(_c(pct).cast(DEC), F.lit(0).cast(DEC))
    return F.when(p <= 0, F.lit(0).cast(DEC)).otherwise(F.round(p * (F.lit(1) - d / F.lit(100)), 2))


def c_to_f(col) -> Column:
    """Celsius → Fahrenheit, rounded to 2."""
    return F.round(_c(col).cast(DEC) * 9 / 5 + 32, 2)


def f_to_c(col) -> Column:
    """Fahrenheit → Celsius, rounded to 2."""
    return F.round(((_c(col).cast(DEC) - 32) * 5 / 9).cast(DEC), 2)


def convert_units(df: DataFrame, col: str, direction: str = "c_to_f", out: str | None = None) -> DataFrame:
    fn = {"c_to_f": c_to_f, "f_to_c": f_to_c}[direction]
    return df.withColumn(out or f"{col}_{direction.split('_')[-1]}", fn(col))


def email_valid(col) -> Column:
    """D3: non-empty, contains ``@``, and the part after the last ``@``
    contains ``.``."""
    c = _c(col)
    return F.coalesce((c != "") & c.contains("@") & F.substring_index(c, "@", -1).contains("."), F.lit(False))


def email_profile(df: DataFrame, col: str, by: str) -> DataFrame:
    """D3 profile: whitespace-delimited tokens holding ``@``, counted by
    validity and ``by``.  Texts without ``@`` hold no such token, so they
    are dropped by a plain ``contains`` before the split."""
    tok = df.filter(F.col(col).contains("@")).select(by, F.explode(
        F.filter(F.split(col, f"{PY_WS}+"), lambda x: x.contains("@"))).alias("token"))
    return tok.groupBy(by, email_valid("token").alias("valid")).agg(F.count(F.lit(1)).alias("n_tokens"))
