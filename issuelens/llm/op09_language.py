"""Language identification with spans for mixed-language texts.

Fit: counts of letter trigrams (with word ends) per language, over at most
about ``max_fit_rows`` labelled rows picked by a hash of the id; the model is
one table of 2^16 hashed trigrams per language.  Use: the script of a word
narrows the languages (those seen in that script), its trigrams score them,
and a Viterbi pass over the words of a text with a penalty for every switch
labels spans.  The language with most letters on the path is the prediction.
All texts of a batch step through the pass together.

Cases: a null text or one without a letter gives ``und`` and score 0; a word
in a script no language was seen in scores all alike, is an ``und`` span and
counts for no language's share; rows are handled one by
one, so repeated or null ids, further columns and an empty table need nothing
special.  With no labelled row every text with letters gives ``und``.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, read

TABLE_BITS = 16
UND = "und"
#: Characters handled at once inside a batch; longer texts are handled alone.
SLICE_CHARS = 1_000_000

# Script ranges (fixed values of the Unicode standard): first, last, script.
SCRIPTS = [
    (0x0041, 0x024F, 1), (0x0370, 0x03FF, 2), (0x0400, 0x052F, 3), (0x0530, 0x058F, 4), (0x0590, 0x05FF, 5),
    (0x0600, 0x077F, 6), (0x0900, 0x097F, 7), (0x0980, 0x09FF, 8), (0x0B80, 0x0BFF, 9), (0x0E00, 0x0E7F, 10),
    (0x10A0, 0x10FF, 11), (0x1E00, 0x1EFF, 1), (0x1F00, 0x1FFF, 2), (0x3040, 0x30FF, 12), (0x3400, 0x9FFF, 13),
    (0xAC00, 0xD7AF, 14),
]
N_SCRIPTS = 16


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per BMP character: letter?, lower case, script."""
    letter = np.array([chr(i).isalpha() for i in range(0x10000)])
    lower = np.arange(0x10000, dtype=np.uint32)
    for i in np.flatnonzero(letter):
        c = chr(i).lower()
        if len(c) == 1:
            lower[i] = ord(c)
    script = np.zeros(0x10000, np.uint8)
    for a, b, s in SCRIPTS:
        script[a:b + 1] = s
    return letter, lower, script


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of the texts, 0 for what is no letter, with one 0
    before, between and after; offsets of the texts."""
    letter, lower, _ = _tables()
    raw = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(raw, 0xFFFF)
    codes = np.where(letter[low] & (raw <= 0xFFFF), lower[low], np.uint32(0))
    far = np.flatnonzero(raw > 0xFFFF)
    if len(far):
        kinds, inverse = np.unique(raw[far], return_inverse=True)
        codes[far] = np.where(np.array([chr(k).isalpha() for k in kinds])[inverse], raw[far], np.uint32(0))
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    return codes, np.concatenate([[1], 1 + np.cumsum(lengths + 1)])


def _features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of letters and the hashed trigram around each."""
    at = np.flatnonzero(codes)
    c = codes.astype(np.uint64)
    h = (c[at - 1] * np.uint64(0x9E3779B97F4A7C15) + c[at]) * np.uint64(0xC2B2AE3D27D4EB4F) + c[at + 1]
    h *= np.uint64(0x165667B19E3779F9)
    return at, (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _slices(texts: list[str]):
    """Index groups of some SLICE_CHARS, texts of like length together."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    group, size = [], 0
    for i in order:
        if group and size + len(texts[i]) > SLICE_CHARS:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(texts[i]) + 1
    if group:
        yield group


def _count(batches):
    sums: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    _, _, script = _tables()
    for b in batches:
        for lang, part in b.groupby("lang"):
            texts = [t for t in part["text"] if t]
            for group in _slices(texts):
                codes, _ = _codes([texts[i] for i in group])
                at, h = _features(codes)
                sums[lang] = sums.get(lang, 0) + np.bincount(h, minlength=1 << TABLE_BITS)
                scripts[lang] = scripts.get(lang, 0) + np.bincount(
                    script[np.minimum(codes[at], 0xFFFF)], minlength=N_SCRIPTS)
    for lang, n in sums.items():
        i = np.flatnonzero(n)
        yield pd.DataFrame({"lang": lang, "slot": i, "n": n[i]})
        j = np.flatnonzero(scripts[lang])
        yield pd.DataFrame({"lang": lang, "slot": -1 - j, "n": scripts[lang][j]})


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        max_fit_rows: int = 20_000) -> dict:
    """Model from rows with a non-null language: languages, log shares of the
    hashed trigrams, allowed (script, language) pairs and per language the mean
    log-score per letter below which a text is noise (halfway between the mean
    of the sample's letters and that of random trigrams).  About ``max_fit_rows``
    rows are used at most, by a hash of the id; the counts are summed in Spark
    and at most languages x 2^16 of them reach the driver."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = rows.select(id_col).count()
    if n > max_fit_rows:
        rows = rows.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int((1 << 30) * max_fit_rows / n))
    counts = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")) \
        .mapInPandas(_count, "lang string, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n")) \
        .toPandas()
    langs = sorted(counts["lang"].unique())
    size = 1 << TABLE_BITS
    logp = np.zeros((size, len(langs)), np.float32)
    allowed = np.zeros((N_SCRIPTS, len(langs)), bool)
    limit = np.zeros(len(langs))
    for k, lang in enumerate(langs):
        c = counts[counts["lang"] == lang]
        grams, scripts = c[c["slot"] >= 0], c[c["slot"] < 0]
        v = np.full(size, 0.5)
        v[grams["slot"].to_numpy()] += grams["n"].to_numpy()
        logp[:, k] = np.log(v / v.sum())
        limit[k] = ((v - 0.5) @ logp[:, k] / max(1.0, (v - 0.5).sum()) + logp[:, k].mean()) / 2
        s = scripts["n"].to_numpy()
        allowed[-1 - scripts["slot"].to_numpy()[s >= 0.01 * s.sum()], k] = True
    return {"langs": langs, "logp": logp, "allowed": allowed, "limit": limit}


def _viterbi(scores: np.ndarray, first: np.ndarray, count: np.ndarray, penalty: float) -> np.ndarray:
    """Best path per text.  ``scores``: words x languages; text i has the words
    first[i] .. first[i] + count[i].  Texts are sorted by falling count, so the
    ones still running at a step are a prefix."""
    n_lang = scores.shape[1]
    stay = np.ones(scores.shape, bool)
    source = np.zeros(len(scores), np.int16)
    path = np.zeros(len(scores), np.int16)
    best = scores[first].copy()
    steps = int(count[0]) if len(count) else 0
    running = np.searchsorted(-count, -np.arange(1, steps + 1), side="right")  # texts with more than t words: running[t]
    for t in range(1, steps):
        k = running[t]
        at = first[:k] + t
        b = best[:k]
        top = b.argmax(axis=1)
        jump = b[np.arange(k), top] - penalty
        keep = b >= jump[:, None]
        stay[at], source[at] = keep, top
        best[:k] = np.where(keep, b, jump[:, None]) + scores[at]
    now = best.argmax(axis=1) if n_lang else np.zeros(len(first), np.int64)
    for t in range(steps - 1, -1, -1):
        k = running[t] if t else len(first)
        at = first[:k] + t
        cur = now[:k]
        path[at] = cur
        if t:
            now[:k] = np.where(stay[at, cur], cur, source[at])
    return path


def label_texts(texts: list[str | None], model: dict, penalty: float) -> list[tuple[str, float, str, float, bool]]:
    """(language, score, spans ``lang:start:end``, share, clear) of every text:
    the share is that of the letters that the path gives to the language, words
    of unseen scripts left out; the score is the share times how much better
    the language explains the whole text than the others.  A text is clear if
    unseen scripts have no more letters than the language and the letters of
    the path's words are no noise (``limit`` of the model)."""
    langs, logp, allowed = model["langs"], model["logp"], model["allowed"]
    _, _, script = _tables()
    out: list[tuple[str, float, str, float, bool]] = [(UND, 0.0, "", 0.0, False)] * len(texts)
    known = [i for i, t in enumerate(texts) if t]
    names = [*langs, UND]
    if not langs:
        return out
    for group in _slices([texts[i] for i in known]):
        ids = [known[i] for i in group][::-1]
        codes, offsets = _codes([texts[i] for i in ids])
        at, h = _features(codes)
        if not len(at):
            continue
        begins = np.flatnonzero(codes[at - 1] == 0)  # of words, among the letters
        letters = np.diff(np.append(begins, len(at)))
        start = at[begins]
        score = np.add.reduceat(logp[h], begins, axis=0)
        ok = allowed[script[np.minimum(codes[start], 0xFFFF)]]
        seen = ok.any(axis=1)
        score[seen[:, None] & ~ok] = -1e4
        score[~seen] = 0
        text_of = np.searchsorted(offsets, start, side="right") - 1
        has, first, count = np.unique(text_of, return_index=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        path = _viterbi(score, first[order], count[order], penalty)
        n_lang = len(langs)
        above = np.bincount(text_of, np.where(
            seen, score[np.arange(len(path)), path] - model["limit"][path] * letters, 0.0), len(ids))
        path = np.where(seen, path, n_lang)
        share = np.zeros((len(ids), n_lang + 1))  # the last column: unseen scripts
        np.add.at(share, (text_of, path), letters)
        totals = np.zeros((len(ids), n_lang))
        totals[has] = np.add.reduceat(score, first, axis=0)
        new = np.flatnonzero(np.append(True, (np.diff(path) != 0) | (np.diff(text_of) != 0)))
        last = np.append(new[1:], len(path)) - 1
        spans: dict[int, list[str]] = {}
        for a, b in zip(new, last):
            t = text_of[a]
            spans.setdefault(t, []).append(
                f"{names[path[a]]}:{start[a] - offsets[t]}:{start[b] + letters[b] - offsets[t]}")
        for t in has:
            k = int(share[t, :n_lang].argmax())
            margin = np.exp(np.clip(totals[t] - totals[t, k], -50, 50))
            sure = 1.0 / max(1.0, float(margin.sum()))
            part = float(share[t, k] / share[t].sum())
            clear = bool(share[t, k] >= max(1, share[t, n_lang]) and above[t] >= 0)
            out[ids[t]] = (langs[k], part * sure, ",".join(spans[t]), part, clear)
    return out


def identify(docs: DataFrame, model: dict, text_col: str = "text", penalty: float = 12.0,
             names: tuple = ("lang_pred", "score", "lang_spans", "lang_share"), keep: list[str] | None = None) -> DataFrame:
    """The input's columns (or those of ``keep``) plus language, score, spans
    and share, and with a fifth name whether the text is clear."""
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x 2^16 floats
    fields = [f for f in docs.schema if f.name in keep]
    kinds = ("string", "double", "string", "double", "boolean")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields),
                        *(f"`{n}` {k}" for n, k in zip(names, kinds))])

    def run(batches):
        for b in batches:
            got = label_texts(b.column(text_col).to_pylist(), shared.value, penalty)
            types = (pa.string(), pa.float64(), pa.string(), pa.float64(), pa.bool_())
            new = [pa.array([g[i] for g in got], t) for i, t in enumerate(types[:len(names)])]
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in fields] + new,
                                             [f.name for f in fields] + list(names))
    return docs.mapInArrow(run, schema)


def op9_language_id(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    out = held("doc_id", 5) == 0
    model = fit(d.filter(~out))
    return identify(d.select("doc_id", out.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
