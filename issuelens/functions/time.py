"""Epoch numbers from timestamps without depending on the session zone.

A ``timestamp_ntz`` value is a wall-clock reading; casting it to
``timestamp`` interprets it in the session time zone (and across daylight
saving changes).  Durations and epoch values of NTZ columns are therefore
taken as a difference from the NTZ epoch instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NTZ_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_micros(df: DataFrame, col: str) -> Column:
    """Microseconds since 1970-01-01 00:00:00 of ``col`` (NTZ: wall clock;
    TIMESTAMP: the instant)."""
    if isinstance(df.schema[col].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, {_NTZ_EPOCH}, `{col}`)")
    return F.unix_micros(F.col(col))


def epoch_millis(df: DataFrame, col: str) -> Column:
    return F.floor(epoch_micros(df, col) / 1000).cast("bigint")
