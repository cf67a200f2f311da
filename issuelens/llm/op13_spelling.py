"""Spelling variants: words one edit apart, found by pivotal grams.

The bigrams of a word are ordered by how many words hold them, rarest first.
A word's gram prefix holds its three rarest bigrams (and all that tie with the
third); its two pivots are the pair of bigrams without a common code point
that costs least, chosen among the three by dynamic programming.  One edit
leaves at least one of two disjoint pivots whole, so of two words one edit
apart the one whose prefix ends earlier in the order has a pivot in the
prefix of the other.  Position limits make the search an equi-join: the pivot
keeps its place if the edit lies behind it (then everything before it is
unchanged as well) and keeps its place from the end if the edit lies before
it (then everything behind it is).  Candidates are verified.

A word's form is its near word of largest count (ties: the smallest) if that
is at least ``ratio`` times its own; ``root`` follows the forms to the end.
Counts grow ``ratio``-fold along forms, so a chain is short and a few rounds
of pointer doubling, given by the largest count, reach its end.

Cases: null and empty texts have no words; a null id is the empty text in the
hash; repeated rows count each; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, read, text_of

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, every: int = 199) -> DataFrame:
    """(word, n) of the runs of letters, some with one code point deleted."""
    text = F.translate(text_of(), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"),
                       F.explode(F.regexp_extract_all(text, F.lit(RUN), 0)).alias("r"))
    # A run shorter than the least length is no word, changed or not.
    runs = runs.filter(F.char_length("r") >= least_length)
    h = F.crc32(F.concat("i", F.lit(":"), "r").cast("binary"))
    at = F.pmod(h, F.char_length("r").cast("bigint")).cast("int")
    word = F.when(F.pmod(h, F.lit(every)) == 0, F.concat(F.substr("r", F.lit(1), at), F.substr("r", at + 2))).otherwise(F.col("r"))
    return runs.select(word.alias("word")).filter(F.char_length("word") >= least_length) \
        .groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _pivots(grams: Column) -> Column:
    """The cheapest pair of disjoint bigrams of a rarity-ordered array of
    (rank, gram, pos).  Left to right by position, the best pair ending at a
    bigram is that bigram and the cheapest one that ends before it starts."""
    by_place = F.array_sort(F.transform(F.slice(grams, 1, 3), lambda g: F.struct(
        g["pos"].alias("pos"), g["rank"].alias("rank"), g["gram"].alias("gram"))))
    none = F.lit(None).cast("struct<cost:bigint,a:int,b:int>")

    def step(best, j):
        here = F.get(by_place, j)

        def before(best, i):
            there = F.get(by_place, i)
            pair = F.struct((there["rank"] + here["rank"]).alias("cost"), i.cast("int").alias("a"), j.cast("int").alias("b"))
            return F.when((there["pos"] + 1 < here["pos"]) & (best.isNull() | (pair < best)), pair).otherwise(best)
        return F.aggregate(F.array(F.lit(0), F.lit(1)), best, lambda b, i: F.when(i < j, before(b, i)).otherwise(b))
    pair = F.aggregate(F.array(F.lit(1), F.lit(2)), none, step)
    return F.array(F.get(by_place, pair["a"]), F.get(by_place, pair["b"]))


def grams_of(words: DataFrame) -> DataFrame:
    """Per word its bigrams (rank, gram, pos) in the global order."""
    last = F.char_length("word") - 1
    grams = F.transform(F.sequence(F.lit(1), last), lambda i: F.substr("word", i, F.lit(2)))
    rows = words.select("word", F.posexplode(grams).alias("pos", "gram"))
    # The alphabet has 90 letters: 8,100 bigrams at most.
    rank = words.select(F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").agg(F.count("*").alias("rank"))
    return rows.join(F.broadcast(rank), "gram").groupBy("word").agg(
        F.array_sort(F.collect_list(F.struct("rank", "gram", "pos"))).alias("grams"))


def near_words(words: DataFrame) -> DataFrame:
    """(a, b): every ordered pair of words that differ by exactly one
    inserted, deleted or replaced code point."""
    third = F.get("grams", F.lit(2))
    g = cut(grams_of(words).select(
        "word", F.char_length("word").alias("len"), F.struct(third["rank"].alias("rank"), third["gram"].alias("gram")).alias("end"),
        _pivots(F.col("grams")).alias("pivots"), "grams"))
    inside = F.filter("grams", lambda x: F.struct(x["rank"].alias("rank"), x["gram"].alias("gram")) <= F.col("end"))
    index = g.select("word", "len", "end", F.explode(inside).alias("g"))
    query = g.select("word", "len", "end", F.explode("pivots").alias("g"))

    def keyed(df, name):
        # What stays unchanged beside the gram: all before it, or all behind it.
        pos = F.col("g.pos")
        left = F.struct(F.lit("<").alias("side"), F.substr("word", F.lit(1), pos + 2).alias("part"))
        right = F.struct(F.lit(">").alias("side"), F.substr("word", pos + 1).alias("part"))
        return df.select(F.col("word").alias(name), F.col("len").alias(name + "_len"), F.col("end").alias(name + "_end"),
                         F.explode(F.array(left, right)).alias("k"), F.col("g.gram").alias("gram"))
    q = keyed(query, "a").withColumn("b_len", F.explode(F.array(F.col("a_len") - 1, F.col("a_len"), F.col("a_len") + 1)))
    found = q.join(keyed(index, "b"), ["gram", "k", "b_len"]) \
        .filter((F.col("a") != F.col("b")) & (F.col("a_end") <= F.col("b_end")) & (F.levenshtein("a", "b", 1) == 1)) \
        .select("a", "b").distinct()
    return found.union(found.select("b", "a")).distinct()


def forms(words: DataFrame, pairs: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root)."""
    other = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"))
    best = F.min(F.struct((-F.col("b_n")).alias("minus"), F.col("b").alias("form")))
    near = pairs.join(other, "b").groupBy("a").agg(F.count("*").alias("n_near"), best.alias("top"))
    enough = -F.col("top.minus") >= ratio * F.col("n")
    return words.join(near.withColumnRenamed("a", "word"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(enough, F.col("top.form")).alias("form"), F.when(enough, -F.col("top.minus")).alias("form_n"))


def roots(found: DataFrame, ratio: int = 5) -> DataFrame:
    """Adds ``root``: the end of the word's chain of forms."""
    links = cut(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    top = found.agg(F.max("n"), F.min("n")).first()
    chain = 1 + int(math.log(max(1.0, (top[0] or 1) / (top[1] or 1)), ratio))
    for _ in range(math.ceil(math.log2(chain))):
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = cut(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return found.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, ratio: int = 5) -> DataFrame:
    words = cut(word_counts(docs))
    found = cut(forms(words, near_words(words), ratio))
    return roots(found, ratio).select("word", "n", "n_near", "form", "form_n", "root")


def op13_spelling_variants(spark, sf_dir):
    return spelling_variants(read(spark, sf_dir, "documents"))
