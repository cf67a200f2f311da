"""X1 with whole records: continuation lines kept over micro-batches.

A log arrives in parts ``(source_file, offset, text, is_last)``: the bytes of
the file from ``offset`` on, cut anywhere (inside a record, a line or between
``\\r`` and ``\\n``), in any order, possibly more than once.  The state of a file
holds the number of bytes and lines taken so far, the text from the start of
its open record on, and the parts that came before their predecessor.  A
record leaves when the next header is complete or the last part has been
taken; then the state is only the number of bytes, so parts that are
delivered again stay without effect.

Lines before the first header are records of their own, as in
:func:`issuelens.sources.logs.parse_log_lines`, whose result on the whole file
this stream equals.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..sources.logs import HEADER_RE, header_time

HEADER = re.compile(HEADER_RE.removeprefix("^"))  # matched at the start of a line
LINE_END = re.compile(r"\r\n|\n|\r")
RECORDS = "source_file string, line_no long, is_record boolean, text string"
STATE = "taken long, lines long, in_record boolean, open string, waiting string, done boolean"


def take(raw: str, in_record: bool, last: bool) -> tuple[list[tuple[int, bool, str]], str, int, bool]:
    """The finished records of ``raw`` as (lines before, is a record, text),
    the text that stays open, the lines before that, and whether it is (in) a
    record.  ``raw`` starts at a record's first line."""
    at, starts = 0, []
    for m in LINE_END.finditer(raw):
        if not last and m.end() == len(raw) and m.group() == "\r":
            break  # its "\n" may follow
        starts.append((at, m.start()))
        at = m.end()
    if last and at < len(raw):
        starts.append((at, len(raw)))
        at = len(raw)
    done, first, opened = [], 0, in_record
    for k, (a, b) in enumerate(starts):
        header = HEADER.match(raw, a, b) is not None
        if k and (header or not opened):
            done.append((first, opened, "\n".join(raw[x:y] for x, y in starts[first:k])))
            first = k
        opened = opened or header
    if starts and (last or not opened):
        # All lines are finished, or the last is one before any header.
        done.append((first, opened, "\n".join(raw[x:y] for x, y in starts[first:])))
        return done, raw[at:], len(starts), opened
    return done, raw[starts[first][0]:] if starts else raw, first, opened


def _follow(key, chunks, state):
    taken, lines, in_record, text, waiting, done = state.get if state.exists else (0, 0, False, "", "[]", False)
    parts = {int(o): (t, bool(e)) for o, t, e in json.loads(waiting)}
    for pdf in chunks:
        for r in pdf.itertuples(index=False):
            if not done and int(r.offset) >= taken:
                parts.setdefault(int(r.offset), (r.text or "", bool(r.is_last)))
    rows = []
    while not done and taken in parts:
        part, done = parts.pop(taken)
        if not part and not done:
            continue
        taken += len(part.encode())
        finished, text, n, in_record = take(text + part, in_record, done)
        rows += [(key[0], lines + k + 1, is_record, t) for k, is_record, t in finished]
        lines += n
    left = [] if done else [[o, t, e] for o, (t, e) in sorted(parts.items())]
    state.update((taken, lines, in_record, "" if done else text, json.dumps(left), done))
    if rows:
        yield pd.DataFrame(rows, columns=["source_file", "line_no", "is_record", "text"])


def stream_whole_records(parts: DataFrame) -> DataFrame:
    """Streaming ``(source_file, line_no, ts, level, message)``; ``line_no`` is
    that of the record's first line.  Parts without a file name or offset are
    ignored."""
    given = parts.filter("source_file IS NOT NULL AND offset IS NOT NULL").select(
        "source_file", F.col("offset").cast("long").alias("offset"), F.col("text").cast("string").alias("text"),
        F.coalesce("is_last", F.lit(False)).alias("is_last"))
    found = given.groupBy("source_file").applyInPandasWithState(_follow, RECORDS, STATE, "append", GroupStateTimeout.NoTimeout)
    t = F.col("text")
    return found.select(
        "source_file", "line_no", F.when(F.col("is_record"), header_time(t)).alias("ts"),
        F.when(F.col("is_record"), F.regexp_extract(t, r"^[^\[]*\[([A-Z]+)\] ", 1)).alias("level"),
        F.when(F.col("is_record"), F.regexp_replace(t, HEADER_RE, "")).otherwise(t).alias("message"))
