"""Collocations, token counts and spelling variants against brute force."""

import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from issuelens.llm import op11_collocations, op12_tokens, op13_spelling

from .conftest import edge_rows, make, rows
from .test_operators import given

LOWER = str.maketrans(op13_spelling.UPPER, op13_spelling.LOWER)


def variants():
    """Words one edit apart in chains, hot and repeated texts, phrases inside longer ones."""
    r = random.Random(11)
    out = [(100 + i, "Harbour lights, harbour lights; the old harbour lights of the town. " * 3, "en" if i % 3 else None, "s")
           for i in range(40)]
    words = ["collocation"] * 150 + ["colocation"] * 30 + ["colocatoin"] * 6 + ["colocatio"] * 6 + ["aaaaaaaa"] * 40 + ["aaaaaaa"] * 7 \
        + ["étéétéé"] * 30 + ["étéétée"] * 6 + ["ÉTÉété×÷"] * 5 + ["abcdef"] * 5 + ["abcdefg"] * 25 + ["zabcdefg"] * 125
    r.shuffle(words)
    out += [(1000 + i, " ".join(words[i::7]), "fr", None) for i in range(7)]
    out += [(None, " ".join(words), None, None)] * 2
    return out


@pytest.fixture(scope="module", params=["edge", "clashing", "given", "variants", "empty"])
def case(request, spark):
    if request.param in ("given", "variants"):
        data = given() if request.param == "given" else variants()
        return make(spark, data), data
    return request.getfixturevalue(request.param), [] if request.param == "empty" else edge_rows()


# 11 ----------------------------------------------------------------------

def phrases_by_force(data, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in data:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(ws)
            for k in (1, 2, 3):
                f[lang].update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        best = []
        for g, a in cand.items():
            inside = [b for t, b in cand.items() if len(t) > len(g) and g in (t[:-1], t[1:])]
            if any(100 * b >= 50 * a for b in inside):
                continue
            score, _, left, right = min((1_000_000 * a * a // (c[g[:k]] * c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))
            best.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def test_collocations_equal_brute_force(case):
    df, data = case
    got = op11_collocations.collocations(df)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == phrases_by_force(data)


def test_collocations_without_broadcast_and_with_ties(spark):
    data = variants()
    got = op11_collocations.collocations(make(spark, data), least=3, top=25, broadcast_bytes=0)
    assert sorted(tuple(r) for r in got.collect()) == phrases_by_force(data, least=3, top=25)


def test_longer_phrases_without_pruning(spark, monkeypatch):
    """A filter of 32 bits lets nearly all through; the result is the same."""
    monkeypatch.setattr(op11_collocations, "_bits", lambda n: 32)
    data = variants()
    got = op11_collocations.collocations(make(spark, data))
    assert sorted(tuple(r) for r in got.collect()) == phrases_by_force(data)


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 3 * 10**14 + 7, 9 * 10**14 + 1, 8 * 10**14 + 3
    df = spark.createDataFrame([(a, [left], [right])], "a bigint, heads array<bigint>, tails array<bigint>")
    assert rows(op11_collocations.scored(df))[0]["score"] == 1_000_000 * a * a // (left * right)


def test_merging_needs_no_shuffle(spark):
    docs = make(spark, variants())
    occ = op11_collocations.occurrences(docs).select("row", "pos", F.xxhash64("word").alias("w1"))
    with op11_collocations._relations(spark) as persist:
        plan = op11_collocations._merged(persist(occ), 1)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan


def test_texts_are_dealt_before_they_become_words(spark):
    """One shuffle by text, below the words; none of the words."""
    occ = op11_collocations.occurrences(make(spark, variants()), 8)
    numbered = occ.join(F.broadcast(occ.select("lang", "word").distinct().withColumn("w1", F.xxhash64("word"))), ["lang", "word"])
    plan = numbered.select("row", "pos", "w1").repartition(8, "row")._jdf.queryExecution().executedPlan().toString()
    streamed = plan.split("BroadcastExchange")[0]
    assert streamed.count("Exchange hashpartitioning(row") == 1 and streamed.index("Generate") < streamed.index("Exchange hashpartitioning(row")


def test_words_and_places(spark):
    text = " .A,b  C\tÉÀ\x85İK ẞ\r\n\nd. .e\x1c\x0bΣΑ Z\u212a!"
    for parts in (None, 4):
        got = sorted((x["pos"], x["word"]) for x in rows(op11_collocations.occurrences(make(spark, [(1, text, "fr", None), (2, None, None, None)]), parts)))
        assert [w for _, w in got] == ["a", "b", "c", "ÉÀ\x85İk", "ẞ", "d", "e\x1c", "ΣΑ", "z\u212a"]
        at = [p for p, _ in got]
        assert [y == x + 1 for x, y in zip(at, at[1:])] == [False, True, True, True, False, False, False, True]
    assert sorted(x["word"] for x in rows(op11_collocations._words(make(spark, [(1, text, "fr", None)])))) == sorted(w for _, w in got)


def test_bloom_filter_lets_through_the_places_of_its_keys(spark):
    from issuelens.functions.bloom import bloom_filter, may_hold
    bits = 1 << 17
    every = spark.range(60000).select("id", F.pmod(F.xxhash64("id"), F.lit(bits)).alias("h"))
    keys = every.filter("id % 7 = 0")
    want = {x["id"] for x in every.join(keys.select("h").distinct(), "h").collect()}
    got = may_hold(every, bloom_filter(keys, ["id"], bits), ["id"], bits)
    assert got.columns == ["id", "h"] and {x["id"] for x in got.collect()} == want and 60000 / 7 < len(want) < 20000


# 12 ----------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(op12_tokens.TOKENIZER))


def test_token_counts_equal_the_library(case, library):
    df, data = case
    got = op12_tokens.count_tokens(df, keep=["doc_id", "text"])
    want = Counter((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _, _ in data)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in rows(got)) == want
    assert op12_tokens.count_tokens(df).columns == [*df.columns, "n_tokens"]


def test_tokens_of_odd_texts(spark, library):
    r = random.Random(12)
    odd = ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "\x85 x  y　z", "\x1c\x1d \x1e\x1f",
           "x͸՘ y", "\U0001F600\U0001F9FF áb", "don't we'll I'd 'S 's", " lead  and   trail \n\n ", "1a2b٣४ Ⅷ½",
           "q" * 300_000, "a b\n " * 300_000, "é" * 5000 + " " + "ß" * 5000]
    chars = "ab é́​あ一'sdt \n\t09<|>.#͸"
    odd += ["".join(r.choice(chars) for _ in range(r.randint(1, 60))) for _ in range(500)]
    df = make(spark, [(i, t, None, None) for i, t in enumerate(odd)])
    got = {x["doc_id"]: x["n_tokens"] for x in rows(op12_tokens.count_tokens(df, keep=["doc_id"], table_size=50))}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(odd)}


def test_pieces_of_long_texts_change_no_count(library):
    pattern = regex.compile(public_tokenizers.PATTERN)
    r = random.Random(3)
    text = "".join(r.choice(["a", "b ", " ", "\n", "'s", "1", "! "]) for _ in range(5000))
    assert "".join(op12_tokens.pieces(text, 64)) == text and len(list(op12_tokens.pieces(text, 64))) > 20
    assert [w for p in op12_tokens.pieces(text, 64) for w in pattern.findall(p)] == pattern.findall(text)


def test_pattern_classes_agree_with_the_library(library):
    pattern = regex.compile(public_tokenizers.PATTERN)
    known = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cn", "Cs", "Co")]
    step = 8192
    for i in range(0, len(known), step):
        for shape in ("a{}a !1", "!{}! a1", "  {}  a1"):
            text = "".join(shape.format(c) for c in known[i:i + step])
            assert [o for _, o in library.pre_tokenizer.pre_tokenize_str(text)] == [m.span() for m in pattern.finditer(text)]


def test_frequent_table_is_bounded_and_round_trips(spark):
    table = op12_tokens.frequent(make(spark, given()), public_tokenizers.path(op12_tokens.TOKENIZER), table_size=300, summary=100)
    words = op12_tokens.unpack(table)
    assert 0 < len(words) <= 300 and op12_tokens.unpack(op12_tokens.pack(list(words.items()))) == words
    counts = {f"w{i}": i for i in range(1000)}
    small = op12_tokens._shrink(dict(counts), 10)
    assert len(small) <= 10 and max(small, key=small.get) == "w999"


# 13 ----------------------------------------------------------------------

def words_by_force(data):
    c = Counter()
    for i, text, *_ in data:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            c[w] += 1
    return {w: n for w, n in c.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def variants_by_force(words):
    near = {a: [b for b in words if abs(len(a) - len(b)) < 2 and one_edit(a, b)] for a in words}
    form = {}
    for a, bs in near.items():
        best = min(bs, key=lambda b: (-words[b], b), default=None)
        form[a] = best if best is not None and words[best] >= 5 * words[a] else None

    def root(a):
        while form[a] is not None:
            a = form[a]
        return a
    return sorted((a, n, len(near[a]), form[a] or "", words.get(form[a], 0), root(a)) for a, n in words.items())


def test_spelling_variants_equal_brute_force(case):
    df, data = case
    got = op13_spelling.spelling_variants(df)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert sorted((r["word"], r["n"], r["n_near"], r["form"] or "", r["form_n"] or 0, r["root"]) for r in rows(got)) \
        == variants_by_force(words_by_force(data))


def test_near_words_of_random_words(spark):
    r = random.Random(13)
    made = {"".join(r.choice("abé") for _ in range(r.randint(6, 9))) for _ in range(700)} | {"a" * k for k in range(6, 12)}
    df = spark.createDataFrame([(w, 5) for w in made], "word string, n bigint")
    got = [tuple(x) for x in op13_spelling.near_words(df).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in made for b in made if a != b and one_edit(a, b)}


def test_pivots_are_disjoint_and_cheapest(spark):
    r = random.Random(14)
    made = ["".join(r.choice("abc") for _ in range(r.randint(6, 10))) for _ in range(200)] + ["aaaaaaa", "abababab"]
    df = spark.createDataFrame([(w, 5) for w in sorted(set(made))], "word string, n bigint")
    for x in rows(op13_spelling.grams_of(df).select("word", "grams", op13_spelling._pivots(F.col("grams")).alias("p"))):
        three = x["grams"][:3]
        cost = min(a["rank"] + b["rank"] for a in three for b in three if a["pos"] + 1 < b["pos"])
        a, b = x["p"]
        assert a["pos"] + 1 < b["pos"] and a["rank"] + b["rank"] == cost


def test_chains_are_followed_to_the_end(spark):
    names = ["abcdefg" + "x" * k for k in range(9)]
    df = spark.createDataFrame([(w, 5 ** (k + 1)) for k, w in enumerate(names)], "word string, n bigint")
    got = rows(op13_spelling.roots(op13_spelling.forms(df, op13_spelling.near_words(df))))
    assert {x["root"] for x in got} == {names[-1]} and len(got) == 9
