"""Each operator against a brute-force version, on edge rows and on the
smallest given documents."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from issuelens.llm import op01_packing, op02_toxicity, op03_simhash, op04_mixing, op05_tokens, op06_substrings
from issuelens.llm import op07_pii, op08_minhash, op09_language, op10_quality
from issuelens.llm.common import scratch
from issuelens.llm.components import components
from issuelens.llm.queries import QUERIES

from ..conftest import SF_SMALL
from .conftest import edge_rows, make, rows

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def given():
    return [(r["doc_id"], r["text"], r["lang"], r["source"])
            for r in pq.read_table(f"{SF_SMALL}/documents.parquet").to_pylist()]


def key(row):
    return tuple((v is None, v) for v in row)


@pytest.fixture(scope="module", params=["edge", "clashing", "given", "empty"])
def case(request, spark):
    """(DataFrame, rows) of each kind of input."""
    if request.param == "given":
        return make(spark, given()), given()
    df = request.getfixturevalue(request.param)
    return df, [] if request.param == "empty" else edge_rows()


# 1 -----------------------------------------------------------------------

def test_packing_places_every_word_once_without_conflicts(case):
    df, docs = case
    cap = 200
    out = rows(op01_packing.pack(df, op01_packing.text_cluster(op01_packing.text_of()), capacity=cap, lane_docs=40))
    want = Counter()
    for i, t, _, s in docs:
        n = len(SPACE.findall(t or ""))
        for k in range(max(1, -(-n // cap))):
            want[(i, k, k * cap, min(cap, n - k * cap), s)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start_word"], r["n_words"], r["source"]) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r["bin"]].append(r)
    words = {i: " ".join(SPACE.findall((t or "").lower())) for i, t, _, _ in docs if i is not None}
    for b in bins.values():
        assert sum(r["n_words"] for r in b) == b[0]["bin_words"] <= cap and len(b) == b[0]["bin_pieces"]
        assert sorted(r["slot"] for r in b) == list(range(len(b)))
        assert max(Counter(r["source"] for r in b).values()) <= 4
        known = [words[r["doc_id"]] for r in b if r["doc_id"] is not None]
        assert len(known) == len(set(known))


def hot_rows(n=200):
    """A third without an id, a third equal rows of one id, the rest as usual."""
    return [(None, f"no id {i % 50} x", "en", "s") for i in range(n)] + [(7, "same text again", "en", "s")] * n + \
        [(100 + i, f"text {i} of many", "en", "t") for i in range(n)]


def test_rows_without_an_id_and_equal_rows_are_dealt_over_lanes_and_blocks(spark, monkeypatch):
    df = make(spark, hot_rows())
    out = rows(op01_packing.pack(df, op01_packing.text_cluster(op01_packing.text_of()), lane_docs=40))
    lanes = Counter(r["bin"] >> 24 for r in out)
    assert len(out) == 600 and len(lanes) == 15 and max(lanes.values()) <= 80
    largest = []

    def spied(items, id_type, fold=op04_mixing._round_blocks):
        largest.append(items.groupBy("source", "block").count().agg(F.max("count")).first()[0])
        return fold(items, id_type)
    monkeypatch.setattr(op04_mixing, "_round_blocks", spied)
    mixed = rows(op04_mixing.mix(df))
    assert len(mixed) == 600 and max(largest) <= 2 * op04_mixing.BLOCK
    assert {r["copies"] for r in mixed if r["doc_id"] == 7} <= {0, 1, 2}


def test_best_fit_takes_the_tightest_compatible_bin():
    r = random.Random(1)
    items = sorted(((r.randint(0, 60), r.choice("abc"), r.choice([None, 1, 2, 3])) for _ in range(400)), key=lambda x: -x[0])
    got, _ = op01_packing.best_fit(items, 100, 2)
    bins: list = []
    for (size, source, cluster), b in zip(items, got):
        fit = [(100 - sum(x[0] for x in c), k) for k, c in enumerate(bins)
               if sum(x[0] for x in c) + size <= 100 and sum(x[1] == source for x in c) < 2
               and (cluster is None or all(x[2] != cluster for x in c))]
        assert b == (min(fit)[1] if fit else len(bins))
        if b == len(bins):
            bins.append([])
        bins[b].append((size, source, cluster))


# 2 -----------------------------------------------------------------------

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_misspellings_equal_brute_force_edit_distance():
    r = random.Random(2)
    lexicon = ["idiot", "worthless", "pathetic", "scum", "moron", "clown"]
    lex = op02_toxicity.Lexicon(lexicon, [], lexicon)
    for _ in range(4000):
        w = list(r.choice(lexicon))
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(w) + 1)
            w[at:at + r.randint(0, 1)] = r.choice(["", "a", "x", "t"])
        t = "".join(w)
        want = t in lexicon or len(t) >= 4 and any(0 < op02_toxicity.allowed_edits(x) >= edits(t, x) for x in lexicon)
        assert bool(lex.look(t)) == want, t


def test_quotations_are_told_from_abuse():
    lex = op02_toxicity.Lexicon(["idiot"], [], ["idiot"])
    assert op02_toxicity.hits_of("you are an idiot", lex, {}) == (1, 0, 0)
    assert op02_toxicity.hits_of("you are an idiott", lex, {}) == (0, 1, 0)
    assert op02_toxicity.hits_of('he said "you idiot" to me', lex, {}) == (0, 0, 1)
    assert op02_toxicity.hits_of("the word idiot is old", lex, {}) == (0, 0, 1)
    assert op02_toxicity.hits_of(None, lex, {}) == op02_toxicity.hits_of("", lex, {}) == (0, 0, 0)


def test_words_inside_tokens_are_hits():
    lex = op02_toxicity.Lexicon(["idiot"], ["moron"], ["idiot"])
    for t in ("idiot's", "you,idiot", "idiot/liar", "idiot—he", "(idiot)", "l'idiot", "1diot", "moronic-ish"):
        assert lex.look(t) == "=" or t == "1diot" and lex.look(t) == "idiot", t
    assert lex.look("you,idiott") == "idiot"
    for t in ("i.d.i.o.t", "river's", "a,b", "12,345", "x—y"):
        assert lex.look(t) == "", t


def test_quotations_may_lower_the_score():
    cells = np.array([[0, 0, 0], [1, 0, 0], [0, 0, 1]])
    beta = op02_toxicity._logistic(cells, np.array([1000.0, 100, 100]), np.array([300.0, 95, 2]))
    z = op02_toxicity._design(cells) @ beta
    assert z[2] < z[0] < z[1] and (beta[1:5] >= 0).all()


def test_toxicity_scores_all_rows(case, spark):
    df, docs = case
    labels = spark.createDataFrame([(5, 1), (7, 0), (8, 0), (None, 1)], "doc_id bigint, toxic int")
    out = rows(op02_toxicity.score(df, op02_toxicity.fit(df, labels), keep=["doc_id"]))
    assert sorted((r["doc_id"] for r in out), key=lambda x: (x is None, x)) == sorted((d[0] for d in docs), key=lambda x: (x is None, x))
    assert all(0 <= r["score"] <= 1 for r in out)


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    y = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{d}/labels.parquet").to_pylist()}
    out = [(r["score"], y[r["doc_id"]]) for r in QUERIES["op2_toxicity"](spark, d).collect() if r["held_out"] and r["doc_id"] in y]
    pos, neg = [s for s, t in out if t], [s for s, t in out if not t]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.93  # one toxic label in twelve marks a text without any such word


def test_rare_terms_and_fixed_phrases_enter_the_lexicon(spark):
    r = random.Random(8)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(300)]

    def prose(*inside):
        w = r.choices(vocab, k=30)
        w.insert(r.randrange(30), " ".join(inside))
        return " ".join(w)
    rare = ["mokosvin", "tosselak"]  # each in 10 of 710 toxic rows
    toxic = [prose("grumpfik") for _ in range(650)] + [prose(w) for w in rare for _ in range(10)]
    toxic += [prose("jyl", "til", "quornly", "zyx") for _ in range(40)]  # always after the same word
    copied = prose("xylophonist")
    toxic += [f"{copied} {w}" for w in vocab[:40]]
    texts = toxic + [prose() for _ in range(2500)]
    docs = make(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, int(i < len(toxic))) for i in range(len(texts))], "doc_id bigint, toxic int")
    model = op02_toxicity.fit(docs, labels)
    assert {"grumpfik", "quornly", *rare} <= set(model["terms"][0]) and "xylophonist" not in model["terms"][0]
    new = make(spark, [(0, prose(rare[0]), "en", "s"), (1, prose("tosselakk"), "en", "s"), (2, prose(), "en", "s")])
    got = {x["doc_id"]: x["score"] for x in rows(op02_toxicity.score(new, model, keep=["doc_id"]))}
    assert got[0] > 0.7 and got[1] > got[2] and got[2] < 0.3


# 3 -----------------------------------------------------------------------

def test_fingerprints_and_edited_texts(case):
    df, docs = case
    out = rows(op03_simhash.edited_pairs(df))
    order = sorted(((i, t or "") for i, t, _, _ in docs), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        nxt, n = order[(k + 1) % len(order)][1], len(t) // 3
        want.append((i, len(t), hashlib.sha256((t[:len(t) - n] + nxt[:n]).encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out), key=key) == sorted(want, key=key)
    by = defaultdict(set)
    for r in out:
        by[r["doc_id"]].add((r["hi"], r["lo"]))
    for i, t in order:
        if i in (5, 6) and len(docs) == len(edge_rows()):
            assert by[5] == by[6]
        if not t and i is not None:
            assert by[i] == {(0, 0)}


def plain_fingerprint(text):
    """One vote per bit and term, counted bit by bit."""
    import xxhash
    w = SPACE.findall((text or "").lower())
    votes, total = [0] * 128, 0
    for i, x in enumerate(w):
        nxt = w[i + 1] if i + 1 < len(w) else ""
        h = xxhash.xxh64_intdigest(nxt.encode(), seed=xxhash.xxh64_intdigest(x.encode(), seed=42))
        h2 = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), seed=xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed=42))
        n = len(x) + len(nxt)
        weight = 1 if n <= 6 else 2 if n <= 10 else 3 if n <= 14 else 4
        total += weight
        for j in range(64):
            votes[j] += weight * (h2 >> j & 1)
            votes[64 + j] += weight * (h >> j & 1)
    return sum(1 << j for j in range(128) if 2 * votes[j] > total)


def test_fingerprints_equal_plain_votes(spark):
    docs = sorted(((i, t or "") for i, t, _, _ in given()), reverse=True)
    out = {r["doc_id"]: r for r in QUERIES["op3_fingerprints"](spark, SF_SMALL).collect()}
    fp = {i: plain_fingerprint(t) for i, t in docs}

    def likeness(a, b):
        return max(0.0, 1 - 2 * bin(a ^ b).count("1") / 128)
    for k, (i, t) in enumerate(docs):
        j, nxt = docs[(k + 1) % len(docs)]
        n = len(t) // 3
        e = plain_fingerprint(t[:len(t) - n] + nxt[:n])
        assert out[i]["fingerprint"] == f"{fp[i]:032x}" and out[i]["edited_fingerprint"] == f"{e:032x}"
        assert out[i]["near_edited"] == likeness(fp[i], e) and out[i]["near_next"] == likeness(fp[i], fp[j])


@pytest.mark.parametrize("seed", [1, 2])
def test_next_document_over_buckets_with_null_and_repeated_ids(spark, monkeypatch, seed):
    monkeypatch.setattr(op03_simhash, "BUCKET_ROWS", 8)
    monkeypatch.setattr(op03_simhash, "MAX_CUTS", 16 if seed == 1 else 64)
    r = random.Random(seed)
    ids = [None] * 100 + [7] * 100 + [r.choice([-1 << 63, (1 << 63) - 1, *range(300)]) for _ in range(150)]
    docs = [(i, f"text {n}", "en", "s") for n, i in enumerate(ids)]
    out = rows(op03_simhash.with_next(make(spark, docs)))
    real = [x for x in out if not x["_ghost"]]
    assert sorted((x["doc_id"], x["text"]) for x in real if x["doc_id"] is not None) == \
        sorted((i, t) for i, t, _, _ in docs if i is not None) and len(real) == len(docs)
    # Every document follows exactly one other, in one ring along the order of ids.
    after, of = {x["text"]: x["next_text"] for x in real}, {t: i for i, t, _, _ in docs}
    assert sorted(after.values()) == sorted(after)
    t = min(after, key=lambda x: (of[x] is None, -(of[x] or 0)))
    seen = [t := after[t] for _ in docs]
    steps = [(of[a] is None, -(of[a] or 0)) > (of[b] is None, -(of[b] or 0)) for a, b in zip(seen, seen[1:])]
    assert len(set(seen)) == len(docs) and sum(steps) <= 1
    assert max(Counter(x["_bucket"] for x in real).values()) <= 60


def test_search_finds_all_within_the_radius(spark):
    r = random.Random(3)

    def signed(x):
        return x - (1 << 64) if x >> 63 else x
    fps = []
    for _ in range(40):
        f = r.getrandbits(128)
        for _ in range(6):
            fps.append(f ^ sum(1 << b for b in r.sample(range(128), r.randint(0, 5))))
    df = spark.createDataFrame([(signed(f >> 64), signed(f & (1 << 64) - 1)) for f in fps], "hi bigint, lo bigint")
    got = {(x["hi"], x["lo"]): x["n_near"] for x in op03_simhash.within_radius(df, df).collect()}
    for f in fps:
        assert got[(signed(f >> 64), signed(f & (1 << 64) - 1))] == sum(bin(f ^ g).count("1") <= 3 for g in fps)


def test_search_names_the_documents_within_the_query_radius(spark):
    out = [r.asDict() for r in QUERIES["op3_fingerprints"](spark, SF_SMALL).collect()]
    asked = [r for r in out if r["doc_id"] % 50 == 0]
    assert asked and all((r["n_near"] is None) == (r["doc_id"] % 50 != 0) for r in out)
    for r in asked:
        far = [(bin(int(r["fingerprint"], 16) ^ int(x["fingerprint"], 16)).count("1"), x["fingerprint"]) for x in out]
        assert r["near_fingerprints"] == [f for _, f in sorted({x for x in far if x[0] <= 6})]
        assert r["n_near"] == sum(n <= 6 for n, _ in far)


# 4 -----------------------------------------------------------------------

def fill(sizes, weights=(3, 1, 2)):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(target.values())
        over = [s for s in free if left * w[s] / sum(w[x] for x in free) > 2 * sizes[s]]
        if not over:
            return target | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            free.discard(s)
        if not free:
            return target


def test_mixing_meets_targets(case):
    df, docs = case
    out = rows(op04_mixing.mix(df))
    size = lambda t: len(SPACE.findall(t or ""))
    assert sorted(((r["doc_id"], r["size"], r["source"]) for r in out), key=key) == \
        sorted(((i, size(t), s) for i, t, _, s in docs), key=key)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for i, t, _, s in docs:
        sizes[s] += size(t)
        largest[s] = max(largest[s], size(t))
    want = fill(sizes) if docs else {}
    for r in out:
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    again = rows(op04_mixing.mix(df))
    assert sorted(((r["doc_id"], r["copies"]) for r in out), key=key) == sorted(((r["doc_id"], r["copies"]) for r in again), key=key)


# 5 -----------------------------------------------------------------------

@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000, 4097])
def test_feistel_is_a_permutation(size):
    x = np.arange(size)
    y = op05_tokens.feistel(x, size, 9)
    assert sorted(y.tolist()) == x.tolist()
    assert op05_tokens.unfeistel(y, size, 9).tolist() == x.tolist()
    if size > 100:
        assert y.tolist() != op05_tokens.feistel(x, size, 10).tolist()


def test_shards_round_trip(case, spark):
    df, docs = case
    layout = op05_tokens.write_shards(df, scratch(spark, "t"), length=16, shard_bytes=20_000)
    if not docs:
        return
    out = rows(op05_tokens.read_shards(spark, layout))
    assert sorted(r["position"] for r in out) == list(range(len(out)))
    assert [r["slot"] for r in sorted(out, key=lambda r: r["position"])] == sorted(r["slot"] for r in out)
    with open(op05_tokens.VOCABULARY, "rb") as f:
        enc = op05_tokens._encoder(f.read())
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: r["seq"]):
        got[r["doc_id"]].append(np.frombuffer(bytes(r["tokens"]), np.uint16)[:r["n_tokens"]].tolist())
    ids = Counter(i for i, *_ in docs)
    for i, t, _, _ in docs:
        if ids[i] == 1 and i is not None:
            tok = [x for part in got[i] for x in part]
            assert tok[-1] == op05_tokens.END and enc.decode(tok[:-1]) == (t or "")


def test_shards_keep_null_and_repeated_ids_and_resume(spark):
    import glob
    docs = [(None, f"no id {n}", "en", "s") for n in range(30)] + [(0, "zero", "en", "s"), (4, "same", "en", "s"), (4, "same", "en", "s"),
                                                                  (4, "other " * 90, "en", "s"), (-9, None, "en", "s")]
    layout = op05_tokens.write_shards(make(spark, docs), scratch(spark, "t"), length=16, shard_bytes=200)
    out = rows(op05_tokens.read_shards(spark, layout))
    assert Counter(r["doc_id"] for r in out if r["seq"] == 0) == Counter(d[0] for d in docs)
    assert layout["shards"] > 3 and all(r["slot"] // layout["width"] == r["shard"] for r in out)
    assert max(Counter(r["shard"] for r in out if r["doc_id"] is None).values()) <= 20
    files = glob.glob(f"{layout['path'].removeprefix('file:')}/shard=*/part-*")
    assert len(files) == len({r["shard"] for r in out})  # a range is one file
    shard = max(out, key=lambda r: r["record"])["shard"]
    of = sorted((r for r in out if r["shard"] == shard), key=lambda r: r["record"])
    with open(next(f for f in files if f"/shard={shard}/" in f), "rb") as f:
        for at in (0, 1, len(of) - 1, len(of)):
            got = list(op05_tokens.resume(f, layout, at))
            assert [g[:4] for g in got] == [(r["slot"], r["doc_id"], r["seq"], r["n_tokens"]) for r in of[at:]]
            assert all(g[4].tobytes() == bytes(r["tokens"])[:2 * r["n_tokens"]] for g, r in zip(got, of[at:]))


def test_ids_beyond_the_key_space_are_refused(spark):
    for ends in ((-1 << 62, 1 << 62), (-1 << 63, (1 << 63) - 1)):
        path = scratch(spark, "t")
        with pytest.raises(ValueError, match="2\\^62"):
            op05_tokens.write_shards(make(spark, [(i, "x", "en", "s") for i in ends]), path)
    layout = op05_tokens.write_shards(make(spark, [(i, "x", "en", "s") for i in (1 << 61, -1 << 60)]), scratch(spark, "t"))
    assert {r["doc_id"] for r in rows(op05_tokens.read_shards(spark, layout))} == {1 << 61, -1 << 60}


# 6 -----------------------------------------------------------------------

def removed_by_force(docs):
    texts = [(i, (t or "").encode()) for i, t, _, _ in docs]
    first = {}
    for i, b in texts:
        if i is not None:
            for p in range(len(b) - 49):
                w = b[p:p + 50]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        for p in range(len(b) - 49):
            if i is not None and first[b[p:p + 50]] < i:
                gone[p:p + 50] = [True] * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def test_repeated_substrings(case):
    df, docs = case
    out = rows(op06_substrings.repeated_bytes(df))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out]
    assert sorted(got, key=key) == sorted(removed_by_force(docs), key=key)


def test_repeated_substrings_across_blocks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(op06_substrings, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(op06_substrings, "BUCKET_BYTES", 9000)
    r = random.Random(6)
    docs = []
    for i in range(120):
        t = "".join(r.choice("abc d") for _ in range(r.randint(0, 400)))
        if docs and r.random() < 0.8:
            o = r.choice(docs)[1]
            for _ in range(r.randint(1, 3)):
                a = r.randint(0, len(o))
                at = r.randint(0, len(t))
                t = t[:at] + o[a:a + r.randint(45, 160)] + t[at:]
        docs.append((i * 7 % 121, t, "en", "s"))
    out = rows(op06_substrings.repeated_bytes(make(spark, docs)))
    got = [(x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in out]
    assert sorted(got) == sorted(removed_by_force(docs))


def test_cover_has_every_difference():
    assert {(a - b) % 31 for a in op06_substrings.COVER for b in op06_substrings.COVER} == set(range(31))


# 7 -----------------------------------------------------------------------

KINDS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(d):
    s = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in s) % 10 == 0


def accepted(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in v.split(".")),
            "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def base_by_force(t):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in KINDS for m in re.finditer(p, t or "") if accepted(k, m[0])]


PII = ["a@b.c+d@e.f", "a@b", "x.y%z@host-1.example.com.", "@a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 255.255.255.255",
       "0001.02.3.0004", "99999999999999999999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112",
       "1 2 3 4", "+1 (017) 555-7713", "+12", "++1 234-567 89 .", "+1 2é 3", "\u0001a@b.c\u0002 \U0001F600 9.9.9.9", "0000 0000 0000 0000 000",
       "7" * 40, "+" + "1" * 16, "é a@b.cé", "a" * 20000 + "@x.y", "1" * 20000, "1.1." * 500, "a@" + "b." * 3000 + "c"]


def test_personal_data_equals_python(spark):
    docs = [(i, t, "en", "s") for i, t in enumerate(PII)]
    r = random.Random(7)
    docs += [(1000 + i, "".join(r.choice("a1.@+- ()2\n") for _ in range(r.randint(0, 60))), "en", "s") for i in range(400)]
    docs += [(10_000 + i, t, lang, s) for i, t, lang, s in given()]
    got = {r["doc_id"]: r for r in rows(op07_pii.find_pii(make(spark, docs)))}
    for i, t, _, _ in docs:
        have = [f"{k}:{x['s']}:{x['e']}" for k, _ in KINDS for x in got[i][k]]
        assert have == base_by_force(t), t[:80]


def test_contexts_of_seeds_find_unseen_identifiers(spark):
    docs = [(i, f"please mail contact: user{i}@host.org today or {i} times", "en", "s") for i in range(40)]
    docs += [(100, "please mail contact: user_at_host99 today", "en", "s"), (101, "nothing near user_at_host98 here", "en", "s")]
    got = {r["doc_id"]: r["context"] for r in rows(op07_pii.find_pii(make(spark, docs)))}
    assert [(x["s"], x["e"]) for x in got[100]] == [(21, 35)] and not got[101]


def test_redaction_keeps_rows_and_columns(case):
    df, docs = case
    out = op07_pii.redact(df)
    assert out.columns == df.columns and out.count() == len(docs)


def test_redaction_replaces_spans(spark):
    out = rows(op07_pii.redact(make(spark, [(1, "é a@b.c, 1.2.3.4 x", "en", "s"), (2, "clean", "en", "s"), (3, None, None, None)])))
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out}
    assert got == {1: ("é [EMAIL], [IP] x", 17), 2: ("clean", 5), 3: (None, None)}


# 8 -----------------------------------------------------------------------

def near_by_force(docs, k=2):
    sets = {}
    for i, t, _, _ in docs:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = SPACE.findall(w)
        n = min(k, len(w))
        sets[i] = {tuple(w[j:j + n]) for j in range(len(w) - n + 1)} if w else set()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    ids = sorted(i for i in sets if i is not None)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                    a, b = find(x), find(y)
                    up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), None if i is None else find(i)) for i in sets}


def test_near_duplicates(case):
    df, docs = case
    out = rows(op08_minhash.near_duplicates(df))
    want = near_by_force(docs)
    assert len(out) == len(docs)
    for r in out:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        else:
            assert r["component_id"] is None


@pytest.mark.parametrize("group_rows, group_shingles", [(6, 2_000_000), (512, 500), (512, 2_000_000)])
def test_near_duplicates_in_large_groups(spark, group_rows, group_shingles):
    """Groups above the chunk size: chains of edits and strays."""
    r = random.Random(8)
    base = [f"w{r.randint(0, 400)}" for _ in range(80)]
    docs = []
    for i in range(90):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 4, 6, 9])):
            w[r.randrange(len(w))] = f"e{r.randint(0, 30)}"
        docs.append((i, " ".join(w), "en", "s"))
    out = rows(op08_minhash.near_duplicates(make(spark, docs), group_rows=group_rows, group_shingles=group_shingles))
    want = near_by_force(docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert len({c for _, c in want.values()}) > 1


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randint(0, 150), r.randint(0, 150)) for _ in range(90)] + [(k, k + 1) for k in range(200, 230)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


# 9 -----------------------------------------------------------------------

def test_viterbi_equals_brute_force():
    r = np.random.default_rng(4)
    counts = np.array([7, 5, 5, 1])
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    s = r.normal(0, 3, (counts.sum(), 3))
    path = op09_language._viterbi(s, first, counts, 2.0)
    for a, n in zip(first, counts):
        best = {(): 0.0}
        for t in range(n):
            best = {(*p, k): v + s[a + t, k] - (2.0 if p and p[-1] != k else 0) for p, v in best.items() for k in range(3)}
        got = tuple(path[a:a + n])
        assert math.isclose(best[got], max(best.values()))


def test_language_of_held_out_rows_and_spans(spark):
    d = "/root/testdata/sf0.1"
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    out = QUERIES["op9_language_id"](spark, d).collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == len(lang) and sum(lang[r["doc_id"]] == r["lang_pred"] for r in held) > 0.99 * len(held)


def test_language_labels_spans_and_scripts(spark):
    en = "the quick brown fox jumps over the lazy dog and runs through the old forest with his friends "
    ru = "быстрая лиса прыгает через ленивую собаку и бежит через старый лес со своими друзьями "
    de = "der schnelle braune fuchs springt über den faulen hund und läuft durch den alten wald mit seinen freunden "
    docs = [(i, t * 3, lang, "s") for i, (t, lang) in enumerate([(en, "en"), (ru, "ru"), (de, "de")] * 4)]
    model = op09_language.fit(make(spark, docs))
    got = op09_language.label_texts([en + ru, de, None, "", "123 ...", "лиса", "日本"], model, 12.0)
    assert got[0][2] == f"en:0:{len(en) - 1},ru:{len(en)}:{len(en + ru) - 1}"
    assert [g[0] for g in got[1:]] == ["de", "und", "und", "und", "ru", got[6][0]] and got[6][0] in ("de", "en", "ru")


def test_language_of_edge_rows(case):
    df, docs = case
    out = op09_language.identify(df.select("doc_id", "text"), op09_language.fit(df), keep=["doc_id"])
    got = rows(out)
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        if r["doc_id"] in (1, 2, 3) and len(docs) == len(edge_rows()):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)


# 10 ----------------------------------------------------------------------

def measures_by_force(t):
    t = t or ""
    w = SPACE.findall(t)
    wins = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    rep = {i + k for i in range(len(w) - 7) if wins[tuple(w[i:i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if SPACE.search(x):
            dup += x in seen
            seen.add(x)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w))


def test_quality_rules(case):
    df, docs = case
    out = rows(op10_quality.judge(df))
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(((r["doc_id"], *[r[c] for c in cols]) for r in out), key=key) == \
        sorted(((i, *measures_by_force(t)) for i, t, _, _ in docs), key=key)


def test_bad_hosts_take_their_documents(spark):
    good = " ".join(f"w{i}" for i in range(40))
    docs = [(i, "short", "en", "bad.org") for i in range(30)] + [(30, good, "en", "bad.org")]
    docs += [(100 + i, good, "en", f"h{i % 5}.org") for i in range(100)]
    got = {r["doc_id"]: r["kept"] for r in rows(op10_quality.judge(make(spark, docs)))}
    assert not got[30] and all(got[100 + i] for i in range(100))


def test_every_rule_counts_for_the_host(spark):
    """Hosts whose documents fail the symbol or the duplicate-line rule only."""
    good = " ".join(f"w{i}" for i in range(40))
    marks = " ".join(f"w{i}##" for i in range(40))
    lines = "\n".join([good] + [f"w{i} and w{i + 1}" for i in range(90)] + ["w0 and w1"] * 3)
    assert not measures_by_force(marks)[-1] and not measures_by_force(lines)[-1]
    docs = [(i, marks, "en", "marks.org") for i in range(30)] + [(30, good, "en", "marks.org")]
    docs += [(40 + i, lines, "en", "lines.org") for i in range(30)] + [(70, good, "en", "lines.org")]
    docs += [(100 + i, good, "en", f"h{i % 5}.org") for i in range(100)]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in rows(op10_quality.judge(make(spark, docs)))}
    assert all(got[i] == (False, i >= 100) for i in got)


# Texts made to collide modulo 2^64 ----------------------------------------

def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def flipped(text):
    return text.translate(str.maketrans("ab", "ba"))


def test_hashes_are_modulo_a_prime():
    from issuelens.llm.hashing import PRIME, BASES, Prefix, _byte_table
    r = np.random.default_rng(1)
    buf = r.integers(0, 256, 40_000, dtype=np.uint8)
    a, b = np.array([0, 5, 16_380, 30_000, 7, 7]), np.array([40_000, 5, 16_390, 39_999, 300, 301])
    p = Prefix(buf)
    table = _byte_table(1).astype(object)
    for k, base in enumerate(BASES):
        plain, at, power = [0], 0, 1
        for x in buf:
            at = (at + int(table[x]) * power) % PRIME
            power = power * base % PRIME
            plain.append(at)
        assert all((int(p.sums[k][i]) - plain[i]) % PRIME == 0 for i in range(0, 40_001, 97))
    copy = np.concatenate([buf[:100], buf])
    assert list(Prefix(copy).of(a + 100, b + 100)) == list(p.of(a, b)) and len(set(p.of(a, b))) == 6
    for n in (1024, 2048, 16_384):
        m = thue_morse(n)
        both = np.frombuffer((m + flipped(m)).encode(), np.uint8)
        x, y = Prefix(both).of(np.array([0, n]), np.array([n, 2 * n]))
        assert x != y


@pytest.mark.parametrize("n", [1024, 2048, 8192])
def test_substrings_of_colliding_texts_stay(spark, n):
    m = thue_morse(n)
    data = [(1, "p" * 7 + "q" * 13 + m + "s" * 12, None, None), (2, "p" * 7 + "q" * 13 + flipped(m) + "s" * 12, None, None)]
    got = [(x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in rows(op06_substrings.repeated_bytes(make(spark, data)))]
    assert sorted(got) == sorted(removed_by_force(data))


def test_colliding_words_are_not_linked(spark):
    m = thue_morse(1024)
    got = rows(op08_minhash.near_duplicates(make(spark, [(1, m, None, None), (2, flipped(m), None, None), (3, m, None, None)]), k=2))
    assert {x["doc_id"]: x["component_id"] for x in got} == {1: 1, 2: 2, 3: 1}
