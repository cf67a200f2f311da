"""Personal data: four base kinds by pattern, further identifiers by
bootstrapped contextual extraction (DataFrame functions only).

Base: emails, IP addresses, card and phone numbers (leftmost matches that do
not overlap within their kind; matches that fail the kind's test are dropped).
Method: the base matches are seed entities.  Every token with a digit or an
``@`` is an instance; the words left and right of it are its lexical patterns.
Patterns and instances form a graph that is scored in turns: a pattern is as
good as the share of known instances among its distinct instances (shrunk by
``prior``), an instance is as good as its best supported patterns together.
After ``rounds`` turns the instances of patterns that reach ``confidence`` with
``support`` distinct seeds are new spans of kind ``context``.

Cases: a null text is empty; U+0001 and U+0002 in a text are ordinary
characters; repeated ids are handled per (id, text); further columns are
ignored (kept by :func:`redact`); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, read, text_of

# Fixed patterns of the task, written so that no part is tried twice: a match
# starts at a run's start (or where the last match ended), and quantifiers
# whose next part cannot match the same character are possessive.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
KINDS = ("email", "ip", "card", "phone")
OPEN, CLOSE = "\u0001", "\u0002"
CONTEXT = "context"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    n = F.length(d)
    x = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(d, i, F.lit(1)).cast("int")
                    * (1 + (n - i) % 2) - F.when(((n - i) % 2 == 1) & (F.substring(d, i, F.lit(1)) > "4"), 9).otherwise(0))
    return F.aggregate(x, F.lit(0), lambda a, y: a + y) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    n = F.length(_digits(v))
    if kind == "ip":
        def part(p):
            p = F.regexp_replace(p, "^0+", "")
            return F.when(F.length(p) <= 3, F.concat(F.lit("0"), p).cast("int") <= 255).otherwise(False)
        return F.forall(F.split(v, r"\."), part)
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(v))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut before every match; each later piece is match, CLOSE, rest."""
    return F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), OPEN)



def _located(pieces: Column) -> Column:
    """Spans (start, end, value) of the pieces, in code points."""
    first = F.length(F.get(pieces, F.lit(0)))
    return F.aggregate(
        F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))),
        F.struct(first.alias("at"), F.array().cast("array<struct<s:int,e:int,v:string>>").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x) - 1).alias("at"),
            F.concat(a["out"], F.array(F.struct(
                a["at"].alias("s"), (a["at"] + F.instr(x, CLOSE) - 1).alias("e"),
                F.substring_index(x, CLOSE, 1).alias("v")))).alias("out")))["out"]


def base_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, _t, _key, email, ip, card, phone): per kind the accepted spans."""
    df = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_t"))
    df = df.withColumn("_key", F.xxhash64("doc_id", "_t")).withColumn("_t", F.translate("_t", OPEN + CLOSE, "\u0003\u0003"))
    needs = {"email": F.col("_t").contains("@"), "ip": F.col("_t").rlike(r"[0-9]\.[0-9]"),
             "card": F.col("_t").rlike("[0-9](?:[ -]?[0-9]){15}"), "phone": F.col("_t").contains("+")}
    pats = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE)))
    none = F.array().cast("array<string>")
    df = df.select("*", *[F.when(needs[k], _pieces(F.col("_t"), pats[k])).otherwise(none).alias(f"_{k}") for k in KINDS])
    return df.select("doc_id", "_t", "_key", *[
        F.when(F.size(f"_{k}") > 1, _accepted(k)).otherwise(
            F.array().cast("array<struct<s:int,e:int,v:string>>")).alias(k) for k in KINDS])


def _accepted(kind: str) -> Column:
    return F.filter(_located(F.col(f"_{kind}")), lambda x: _valid(kind, x["v"]))


def _word(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^[\p{Punct}]+|[\p{Punct}]+$", ""))


def with_candidates(spans: DataFrame) -> DataFrame:
    """Adds ``cand``: tokens with a digit or ``@`` with the words beside them.
    Drops the text, so what is kept grows with the identifiers only."""
    p = F.col("_p")
    df = spans.withColumn("_p", F.when(F.col("_t").rlike("[0-9@]"), _pieces(F.col("_t"), TOKEN))
                          .otherwise(F.array().cast("array<string>")))
    near = 80  # characters looked at for the neighbouring word (a feature's width, not a cap on texts)
    sp = r"[\x20\x09-\x0D]"
    df = df.withColumn("_c", F.when(F.size(p) > 1, _located(p)).otherwise(
        F.array().cast("array<struct<s:int,e:int,v:string>>")))
    prev = F.transform(p, lambda x: _word(F.regexp_extract(F.right(F.replace(x, F.lit(CLOSE), F.lit("")), F.lit(near)),
                                                           rf"([^\x20\x09-\x0D]+){sp}*$", 1)))
    tail = F.transform(p, lambda x: F.left(F.substring_index(x, CLOSE, -1), F.lit(near)))
    df = df.withColumn("_prev", prev).withColumn("_tail", tail)
    return df.select("doc_id", "_key", *KINDS, F.transform("_c", lambda c, i: F.struct(
        c["s"].alias("s"), c["e"].alias("e"), F.lower(c["v"]).alias("v"),
        F.get("_prev", i).alias("l"),
        _word(F.regexp_extract(F.concat(F.get("_tail", i + 1), F.lit(" ")), rf"^{sp}*([^\x20\x09-\x0D]+)", 1)).alias("r"),
        F.exists(F.concat(*KINDS), lambda b: (b["s"] < c["e"]) & (b["e"] > c["s"])).alias("seed"))).alias("cand"))


def discover(found: DataFrame, rounds: int = 3, confidence: float = 0.8, support: int = 5, prior: float = 2.0,
             min_length: int = 6) -> DataFrame:
    """Rows (_key, s, e): tokens that are no seeds but stand in patterns that
    the seeds induced."""
    c = found.select("_key", F.explode("cand").alias("c")).select("_key", "c.*") \
        .filter(F.col("seed") | (F.length("v") >= min_length))
    pats = F.array_compact(F.array(
        F.when(F.col("l") != "", F.concat(F.lit("l:"), "l")), F.when(F.col("r") != "", F.concat(F.lit("r:"), "r")),
        F.when((F.col("l") != "") & (F.col("r") != ""), F.concat(F.lit("b:"), "l", F.lit(" "), "r"))))
    # Distinct (pattern, value) edges: copies of a document add nothing.
    edges = cut(c.select(F.explode(pats).alias("pat"), "v", "seed").groupBy("pat", "v")
                .agg(F.max("seed").alias("seed")))
    scored = edges.withColumn("conf", F.col("seed").cast("double"))
    good = None
    for _ in range(rounds):
        good = scored.groupBy("pat").agg(
            (F.sum("conf") / (F.count("*") + prior)).alias("pc"), F.sum(F.col("seed").cast("int")).alias("n")) \
            .filter((F.col("pc") >= confidence) & (F.col("n") >= support))
        good = cut(good)
        inst = edges.join(good, "pat").groupBy("v").agg(
            (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("pc"), F.lit(1e-6)))))).alias("ic"))
        scored = cut(edges.join(inst, "v", "left").select(
            "pat", "v", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("ic", F.lit(0.0))).alias("conf")))
    return c.filter(~F.col("seed")).select("_key", "s", "e", F.explode(pats).alias("pat")) \
        .join(good.select("pat"), "pat", "left_semi").select("_key", "s", "e").distinct()


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bootstrap) -> DataFrame:
    """Per row: doc_id, _key, one span array per base kind and ``context``."""
    found = cut(with_candidates(base_spans(docs, id_col, text_col)))
    extra = discover(found, **bootstrap).groupBy("_key").agg(
        F.sort_array(F.collect_list(F.struct("s", "e"))).alias(CONTEXT))
    return found.drop("cand").join(extra, "_key", "left").withColumn(
        CONTEXT, F.coalesce(CONTEXT, F.array().cast("array<struct<s:int,e:int>>")))


def _printed(kind: str) -> Column:
    return F.transform(F.col(kind), lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def _labelled(kind: str) -> Column:
    return F.transform(F.col(kind), lambda x: F.struct(
        x["s"].alias("s"), x["e"].alias("e"), F.lit(f"[{kind.upper()}]").alias("k")))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars",
           **bootstrap) -> DataFrame:
    """The input with every span replaced by ``[KIND]`` (overlapping spans as
    one, named by the first), other columns and rows as they are."""
    spans = find_pii(docs, id_col, text_col, **bootstrap)
    every = F.sort_array(F.concat(*[_labelled(k) for k in (*KINDS, CONTEXT)]))
    spans = spans.select("_key", every.alias("_spans")).filter(F.size("_spans") > 0).dropDuplicates(["_key"])
    df = docs.withColumn("_key", F.xxhash64(F.col(id_col), text_of(text_col))).join(spans, "_key", "left")
    t = F.col(text_col)
    cutout = F.aggregate(
        F.col("_spans"), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, x: F.when(x["s"] >= a["at"], F.struct(
            x["e"].alias("at"), F.concat(a["out"], F.array(F.substring(t, a["at"] + 1, x["s"] - a["at"]), x["k"])).alias("out")))
        .otherwise(F.struct(F.greatest(a["at"], x["e"]).alias("at"), a["out"].alias("out"))),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(t, a["at"] + 1, F.length(t))))
    df = df.withColumn(text_col, F.when(F.col("_spans").isNotNull(), cutout).otherwise(t))
    if length_col in docs.columns:
        df = df.withColumn(length_col, F.when(F.col("_spans").isNotNull(), F.length(text_col).cast(
            docs.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return df.select(*docs.columns)


def op7_pii(spark, sf_dir):
    p = find_pii(read(spark, sf_dir, "documents"))
    base = F.array_join(F.concat(*[_printed(k) for k in KINDS]), ",")
    return p.select("doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS],
                    F.sha2(base, 256).alias("base_sha256"),
                    F.array_join(F.concat(*[_printed(k) for k in (*KINDS, CONTEXT)]), ",").alias("spans"),
                    F.size(CONTEXT).cast("bigint").alias("n_context"))
