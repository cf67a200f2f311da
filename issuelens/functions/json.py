"""Strict JSON texts, as ``json.loads`` reads them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRICT = {"allowSingleQuotes": "false"}


def strict_json(col) -> Column:
    """The text if it is exactly one JSON value, else NULL.

    Spark's parser stops at the end of the first value and takes single
    quotes; inside an array and inside an object, whatever follows the value
    (``{"a": 1} more``, ``{}],[{}``) makes one of the two readings fail."""
    c = F.col(col) if isinstance(col, str) else col
    alone = F.size(F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>", STRICT)) == 1
    inside = F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), "struct<v:string,_bad:string>",
                         {**STRICT, "columnNameOfCorruptRecord": "_bad"})
    return F.when(alone & inside["_bad"].isNull(), c)
