"""Toxicity scores from a lexicon, misspellings included.

Fit: on at most about ``max_fit_rows`` labelled rows, words and word stems
that stand far more often in toxic than in other documents become the lexicon
(counts by Spark; terms are admitted by their evidence, not by their share of
the toxic rows, and near copies of a toxic text count once).  Use: each
token is looked up in a trie of the lexicon with a Levenshtein automaton that
walks the trie (one row of the edit table per trie node, cut off where every
entry exceeds the allowed edits); words whose near misses are ordinary words
in the fit rows take part exactly only.  Each hit is then judged by a window of
tokens around it: inside quotation marks or after a reporting word it is a
quotation, else abuse.  A logistic model over the counts of exact, misspelled
and quoted hits, fitted on the same rows, gives the score; a quotation may lower
it.  Counts beyond 8 exact, 4 misspelled and 4 quoted hits count as these.

Cases: a null or empty text has no hits and gets the base score; rows are
scored one by one (repeated or null ids, further columns); an empty table
gives no rows; with no labels the lexicon is empty and every score is low.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held, read
from .op08_minhash import near_duplicates

# Quotation marks, reporting words, look-alike characters.
OPENING = "\"'“„«‘‚"
CLOSING = "\"'”“»’"
REPORTING = {"said", "says", "called", "calls", "wrote", "quoted", "quote", "word", "words", "term", "slur", "insult",
             "sagte", "nannte", "schrieb", "wort", "beleidigung", "dit", "appelé", "mot", "insulte", "écrit",
             "dijo", "llamó", "palabra", "insulto", "escribió"}
LOOKALIKE = str.maketrans("013457@$", "oieastas")
EDGE = " \t.,;:!?()[]{}<>\"'“”„«»‘’‚*#%&|~_-"
#: Fixed value: the runs of letters that the lexicon is learned from.
LETTERS = regex.compile(r"\p{L}+")
STEMS = (4, 5, 6, 7)
WINDOW = 8
MEMO = 400_000
BINS = (8, 4, 4)  # exact, misspelled, quoted hits that the model tells apart


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """Trie of words and stems (a stem matches every longer word).

    ``fuzzy`` words also match misspelled.  A word cut into edits + 1 pieces
    keeps one of them when misspelled: the first stays at the front, the last
    at the end, a middle one moves by an edit at most.  Tokens that hold no
    piece skip the trie."""

    def __init__(self, words, stems, fuzzy):
        self.exact, self.stems = set(words), set(stems)
        self.lengths = sorted({len(s) for s in stems})
        self.most = max(map(allowed_edits, fuzzy), default=0)
        self.root: dict = {}
        pieces: dict[tuple, set[str]] = {}
        for w in fuzzy:
            e, n = allowed_edits(w), len(w)
            if not e:
                continue
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
            cuts = [n * i // (e + 1) for i in range(e + 2)]
            pieces.setdefault((0, cuts[1]), set()).add(w[:cuts[1]])
            pieces.setdefault((cuts[-2] - n, None), set()).add(w[cuts[-2]:])
            if e == 2:
                for move in (-1, 0, 1):
                    pieces.setdefault((cuts[1] + move, cuts[2] + move), set()).add(w[cuts[1]:cuts[2]])
        self.pieces = [(slice(*k), v) for k, v in pieces.items()]

    def near(self, token: str) -> str:
        """The first trie word that the token's Levenshtein automaton accepts."""
        most, n = self.most, len(token)
        stack = [(self.root, list(range(n + 1)))]
        while stack:
            node, row = stack.pop()
            for c, child in node.items():
                if c == "":
                    if row[n] <= allowed_edits(child):
                        return child
                    continue
                new = [row[0] + 1]
                for i in range(1, n + 1):
                    new.append(min(new[i - 1] + 1, row[i] + 1, row[i - 1] + (token[i - 1] != c)))
                if min(new) <= most:
                    stack.append((child, new))
        return ""

    def look(self, raw: str) -> str:
        """"" no hit, "=" exact word or stem, else the word that is misspelled:
        of the token without the marks at its ends, else (``idiot's``,
        ``you,idiot``) of one of its runs of letters, which the lexicon is
        learned from."""
        t = raw.strip(EDGE)
        found = self._look(t)
        if found or t.isalpha():
            return found
        runs = [self._look(x) for x in LETTERS.findall(t)]
        return "=" if "=" in runs else next(filter(None, runs), "")

    def _look(self, t: str) -> str:
        if len(t) < 3:
            return ""
        if t in self.exact or any(t[:k] in self.stems for k in self.lengths if len(t) > k):
            return "="
        plain = t.translate(LOOKALIKE)
        if plain != t and plain in self.exact:
            return plain
        if len(plain) >= 4 and any(plain[k] in v for k, v in self.pieces):
            return self.near(plain)
        return ""


@lru_cache(maxsize=4)
def _lexicon(words: tuple, stems: tuple, fuzzy: tuple) -> tuple[Lexicon, dict]:
    return Lexicon(words, stems, fuzzy), {}


def quoted(tokens: list[str], i: int) -> bool:
    """Is hit i a quotation: marks open before and close after it inside the
    window, or a reporting word close before it?"""
    lo, hi = max(0, i - WINDOW), min(len(tokens), i + WINDOW + 1)
    if any(t.strip(EDGE) in REPORTING for t in tokens[max(0, i - 4):i]):
        return True
    opened = False
    for t in tokens[lo:i + 1]:
        if t[0] in OPENING:
            opened = True
        if opened and t is not tokens[i] and t.rstrip(".,;:!?")[-1:] in tuple(CLOSING) and len(t) > 1:
            opened = False
    return opened and any(t.rstrip(".,;:!?")[-1:] in tuple(CLOSING) for t in tokens[i:hi])


def found_in(text: str | None, lex: Lexicon, memo: dict) -> tuple[list[str], list[str]]:
    """Tokens of a text and the lexicon's answer for each."""
    tokens = text.lower().split() if text else []
    if len(memo) > MEMO:
        memo.clear()
    for t in set(tokens).difference(memo):
        memo[t] = lex.look(t)
    return tokens, [memo[t] for t in tokens]


def hits_of(text: str | None, lex: Lexicon, memo: dict) -> tuple[int, int, int]:
    """Exact, misspelled and quoted hits of a text."""
    tokens, found = found_in(text, lex, memo)
    n = [0, 0, 0]
    for i, f in enumerate(found):
        if f:
            n[2 if quoted(tokens, i) else f != "="] += 1
    return n[0], n[1], n[2]


def _design(n: np.ndarray) -> np.ndarray:
    n = np.minimum(n, BINS).astype(float)
    return np.column_stack([np.ones(len(n)), n[:, 0] > 0, np.log1p(n[:, 0]), n[:, 1] > 0, np.log1p(n[:, 1]),
                            n[:, 2] > 0, np.log1p(n[:, 2])])


def _logistic(cells: np.ndarray, weight: np.ndarray, toxic: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Newton's method with a ridge on the cells' counts (a few hundred rows);
    abuse never lowers a score, so its weights below 0 are set to 0, while
    quotations may speak against toxicity."""
    x, beta = _design(cells), np.zeros(7)
    reg = np.diag([1e-3] + [ridge] * 6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + reg, x.T @ (toxic - weight * p) - reg @ beta)
        beta += np.clip(step, -4, 4)
        beta[1:5] = np.maximum(beta[1:5], 0)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _misspelled(rows: DataFrame, terms: tuple) -> DataFrame:
    """(word, a, b): toxic and other rows with a misspelling of a lexicon word."""
    shared = rows.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        lex, memo = _lexicon(*shared.value)
        for b in batches:
            out = [(w, y) for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist())
                   for w in sorted(set(found_in(t, lex, memo)[1]) - {"", "="})]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.string()),
                                              pa.array([y for _, y in out], pa.int32())], ["word", "toxic"])
    return rows.mapInArrow(run, "word string, toxic int").groupBy("word").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))


def _scan(docs: DataFrame, text_col: str, terms: tuple, keep: list[str]) -> DataFrame:
    """The columns ``keep`` plus n_exact, n_misspelled, n_quoted."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # at most the forms of the fit sample
    fields = [f for f in docs.schema if f.name in keep]
    new = ("n_exact", "n_misspelled", "n_quoted")

    def run(batches):
        lex, memo = _lexicon(*shared.value)
        for b in batches:
            n = [hits_of(t, lex, memo) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(f.name) for f in fields] + [pa.array([x[k] for x in n], pa.int64()) for k in range(3)],
                [f.name for f in fields] + list(new))
    return docs.mapInArrow(run, ", ".join(
        [*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{c} bigint" for c in new)]))


def distinct_texts(rows: DataFrame) -> DataFrame:
    """(text, toxic, copy) from rows (text, toxic): every text of a label once;
    ``copy`` names the near-duplicate group (pairs of words, similarity 0.8)
    of a toxic text, so that edited copies are one piece of evidence."""
    texts = cut(rows.filter(F.col("text").isNotNull()).select("text", "toxic").distinct()
                .withColumn("doc_id", F.xxhash64("text")))
    toxic = texts.filter("toxic = 1")
    groups = near_duplicates(toxic, k=2, percent=80).select("doc_id", F.col("component_id").alias("copy"))
    other = texts.filter("toxic = 0").withColumn("copy", F.lit(None).cast("bigint"))
    return cut(toxic.join(groups, "doc_id").unionByName(other).select("text", "toxic", "copy"))


def learn_terms(texts: DataFrame, min_docs: int = 3, purity: float = 0.985) -> tuple[tuple, tuple]:
    """(words, stems) from ``distinct_texts``: forms in at least ``min_docs``
    toxic texts (near copies count once) whose rate there is ``purity`` of both
    rates and whose log-likelihood ratio is beyond what the best of as many
    forms without a tie to the label would reach by chance (2 ln forms).  No
    bound grows with the number of toxic texts, so a rare language or topic
    needs as many texts as a common one.  A stem under a shorter one adds nothing."""
    size = texts.agg(F.countDistinct("copy"), F.sum(1 - F.col("toxic"))).first()
    n_toxic, n_other = size[0] or 0, size[1] or 0
    rows = texts.select("copy", "toxic", F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w"))
    stems = [F.transform(_longer("w", k), _stem(k)) for k in STEMS]
    forms = rows.select("copy", "toxic", F.explode(F.array_distinct(F.concat(_longer("w", 2), *stems))).alias("form"))
    counts = cut(forms.groupBy("form").agg(F.countDistinct("copy").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
                 .filter(F.col("a") + F.col("b") >= min_docs))
    limit = 2 * math.log(max(1, counts.count()))
    ra, rb = F.col("a") / max(1, n_toxic), (F.col("b") + 0.5) / max(1, n_other)
    both = (F.col("a") + F.col("b")) / max(1, n_toxic + n_other)
    ratio = 2 * (F.col("a") * F.log(ra / both) + F.when(
        F.col("b") > 0, F.col("b") * F.log(F.col("b") / max(1, n_other) / both)).otherwise(0.0))
    # At most the forms of the fit sample reach the driver.
    got = counts.filter((F.col("a") >= min_docs) & (ra / (ra + rb) >= purity) & (ratio > limit)).select("form").collect()
    stems_found = sorted((r["form"][:-1] for r in got if r["form"].endswith("*")), key=len)
    taken: set[str] = set()
    for s in stems_found:
        if not any(s[:k] in taken for k in STEMS if k < len(s)):
            taken.add(s)
    words = [r["form"] for r in got if not r["form"].endswith("*")]
    return tuple(sorted(words)), tuple(sorted(taken))


def _longer(col: str, k: int):
    return F.filter(F.col(col), lambda x: F.length(x) > k)


def _stem(k: int):
    return lambda x: F.concat(F.substring(x, 1, k), F.lit("*"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_fit_rows: int = 20_000) -> dict:
    """Lexicon and weights from labelled rows, at most about ``max_fit_rows``."""
    y = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()) \
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    n = y.count()
    if n > max_fit_rows:
        y = y.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int((1 << 30) * max_fit_rows / n))
    # The sample is bounded by max_fit_rows (16 bytes a row): broadcast it.
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")) \
        .join(F.broadcast(y), "_id").select("text", "toxic")
    rows = cut(rows)  # the passes below read the sample, not the corpus
    size = y.agg(F.sum("toxic"), F.count("*")).first()
    n_other = size[1] - (size[0] or 0)
    words, stems = learn_terms(distinct_texts(rows))
    # Misspellings count for words whose near misses are not ordinary words:
    # at most one other row in 2000 holds one.
    common = {r["word"] for r in _misspelled(rows, (words, stems, words)).filter(
        F.col("b") > 1 + n_other // 2000).collect()}
    terms = (words, stems, tuple(w for w in words if w not in common))
    cells = _scan(rows, "text", terms, ["toxic"])
    cells = cells.groupBy(*[F.least(c, F.lit(m)).alias(c) for c, m in zip(cells.columns[1:], BINS)]).agg(
        F.count("*").alias("n"), F.sum("toxic").alias("t")).toPandas()
    beta = _logistic(cells.iloc[:, :3].to_numpy(), cells["n"].to_numpy(float), cells["t"].to_numpy(float)) \
        if len(cells) else np.array([-3.0, 0, 0, 0, 0, 0, 0])
    return {"terms": terms, "beta": beta}


def score(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` plus hit counts and ``score``."""
    keep = docs.columns if keep is None else keep
    d = _scan(docs, text_col, model["terms"], keep)
    z = F.lit(float(model["beta"][0]))
    for i, (c, m) in enumerate(zip(("n_exact", "n_misspelled", "n_quoted"), BINS)):
        n = F.least(F.col(c), F.lit(m))
        z = z + F.when(n > 0, float(model["beta"][2 * i + 1])).otherwise(0.0) + F.log1p(n) * float(model["beta"][2 * i + 2])
    return d.withColumn("score", 1 / (1 + F.exp(-z)))


def op2_toxicity(spark, sf_dir):
    d, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    out = held("doc_id", 3) == 1
    model = fit(d, labels.filter(~out))
    return score(d.select("doc_id", out.alias("held_out"), "text"), model, keep=["doc_id", "held_out"]) \
        .withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
