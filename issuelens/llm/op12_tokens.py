"""Token counts by a two-tier lookup on the map side.

A text is cut into pre-tokens by the tokenizer's own pattern; the number of
tokens of a pre-token depends on nothing around it.  First tier: a compact
table (one byte string of keys, one of key lengths, one of token counts) of
the most frequent pre-tokens, broadcast; at most ``table_size`` keys of at
most ``KEY_BYTES`` bytes, so its size is bounded whatever the input.  Second
tier: misses are encoded by the library and remembered in a cache of the
Python worker of at most two times ``CACHE`` entries.  No pre-token is
shuffled: the frequent ones are found by Misra-Gries summaries, one per task
and of ``summary`` entries at most, over all texts.  The table only decides
what is looked up where, never a result.

Cases: a null or empty text has 0 tokens; a special string inside a text is
one token (the library's default); texts with code points that the pattern
library may know from a later Unicode version are encoded whole; a null id,
repeated rows and extra columns pass through; an empty table gives an empty
table; a text of any length is cut at spaces after other characters, where
pre-tokens end in any case.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import read, text_of

TOKENIZER = "byte_bpe_50k.json"
KEY_BYTES = 48
CACHE = 400_000
PIECE = 1 << 20


#: Every code point up to U+0377 has a category.
LATER = re.compile(r"[^\x00-\u0377]")


def _unassigned(text: str) -> bool:
    """Whether a code point has no category: the only ones that two versions
    of Unicode can put into different classes of the pattern."""
    return not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(LATER.findall(text)))


@lru_cache(maxsize=1)
def _load(path: str):
    """(tokenizer, pattern, special strings) of a byte-level BPE file."""
    tok = Tokenizer.from_file(path)
    made = json.loads(tok.to_str())
    pre = made["pre_tokenizer"] or {}
    plain = not made["normalizer"] and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") \
        and pre.get("use_regex", True)
    special = [t for t in made["added_tokens"]]
    if not plain or any(t[f] for t in special for f in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: only byte-level tokenizers without normalizer are counted by pre-token")
    # Alternatives in the library's order, the longest first, as strings of a text.
    strings = sorted((t["content"] for t in special), key=len, reverse=True)
    return tok, regex.compile(public_tokenizers.PATTERN), \
        re.compile("|".join(map(re.escape, strings))) if strings else None


class _Lengths(dict):
    """Pre-token -> number of tokens; a missing one is encoded and cached.
    The cache has two generations: when the young one is full it becomes the
    old one, from which words in use come back."""

    def __init__(self, tok: Tokenizer, table: dict):
        super().__init__(table)
        self.tok, self.table, self.old = tok, table, {}

    def __missing__(self, word: str) -> int:
        n = self.old.get(word)
        if n is None:
            n = len(self.tok.encode(word, add_special_tokens=False))
        if len(word) <= KEY_BYTES:
            if len(self) >= len(self.table) + CACHE:
                self.old = dict(self)
                self.clear()
                self.update(self.table)
            self[word] = n
        return n


def pieces(text: str, size: int = PIECE):
    """Parts of a long text, cut before a space that follows a non-space."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def _plain(text: str, special) -> tuple[list[str], int]:
    """The text between special strings, and their number."""
    if special is None or special.search(text) is None:
        return [text], 0
    between = special.split(text)
    return between, len(between) - 1


def count(text: str | None, lengths: _Lengths, pattern, special) -> int:
    if not text:
        return 0
    between, n = _plain(text, special)
    for part in between:
        if _unassigned(part):
            n += len(lengths.tok.encode(part, add_special_tokens=False).ids)
        else:
            for piece in pieces(part):
                n += sum(map(lengths.__getitem__, pattern.findall(piece)))
    return n


def pack(rows: list[tuple[str, int]]) -> tuple[bytes, bytes, bytes]:
    """The compact table of (pre-token, number of tokens)."""
    keys = [k.encode() for k, _ in rows]
    return zlib.compress(b"".join(keys)), bytes(map(len, keys)), bytes(n for _, n in rows)


def unpack(table: tuple[bytes, bytes, bytes]) -> dict[str, int]:
    keys, sizes, counts = table
    keys, at, out = zlib.decompress(keys), 0, {}
    for size, n in zip(sizes, counts):
        out[keys[at:at + size].decode()] = n
        at += size
    return out


@lru_cache(maxsize=1)
def _lengths(path: str, table: tuple[bytes, bytes, bytes]) -> _Lengths:
    """One lookup per Python worker, kept from task to task."""
    return _Lengths(_load(path)[0], unpack(table))


def _shrink(counts: dict[str, int], size: int) -> dict[str, int]:
    """Misra-Gries step: take the size-th largest count off all."""
    if len(counts) <= size:
        return counts
    off = sorted(counts.values(), reverse=True)[size]
    return {k: n - off for k, n in counts.items() if n > off}


def frequent(docs: DataFrame, path: str, text_col: str = "text", table_size: int = 262_144, summary: int = 16_384) -> tuple:
    """The compact table of the most frequent pre-tokens of all texts."""
    def summarise(batches):
        _, pattern, special = _load(path)
        counts: dict[str, int] = {}
        for b in batches:
            for t in b.column(0):
                for part in _plain(t.as_py(), special)[0]:
                    for piece in pieces(part):
                        for w in pattern.findall(piece):
                            counts[w] = counts.get(w, 0) + 1
                        if len(counts) > 8 * summary:
                            counts = _shrink(counts, summary)
        short = [(k, n) for k, n in _shrink(counts, summary).items() if len(k.encode()) <= KEY_BYTES]
        if short:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in short], pa.string()),
                                              pa.array([n for _, n in short], pa.int64())], ["word", "n"])

    def encode(batches):
        tok = _load(path)[0]
        for b in batches:
            made = tok.encode_batch(b.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(e.ids) for e in made], pa.int64())], ["word", "n"])

    top = docs.select(text_of(text_col).alias("text")).mapInArrow(summarise, "word string, n bigint") \
        .groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(table_size)
    # At most table_size short strings reach the driver.
    return pack([(r["word"], r["n"]) for r in top.select("word").mapInArrow(encode, "word string, n bigint").collect()])


def count_tokens(docs: DataFrame, path: str | None = None, text_col: str = "text", name: str = "n_tokens",
                 keep: list[str] | None = None, table_size: int = 262_144) -> DataFrame:
    """The input's columns (or those of ``keep``) plus the number of tokens."""
    path = path or public_tokenizers.path(TOKENIZER)
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, path, text_col, table_size))
    source = docs.select(*[F.col(f"`{c}`") for c in keep], text_of(text_col).alias("_il_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in keep]).schema),
                        f"`{name}` bigint"])

    def run(batches):
        _, pattern, special = _load(path)
        lengths = _lengths(path, shared.value)
        for b in batches:
            n = [count(t.as_py(), lengths, pattern, special) for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(n, pa.int64())], [*keep, name])
    return source.mapInArrow(run, schema)


def op12_token_counts(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(
        "doc_id", "text", F.octet_length(text_of()).cast("bigint").alias("n_bytes"))
    return count_tokens(d, keep=["doc_id", "n_bytes"]).withColumn("over_limit", F.col("n_tokens") > 512)
