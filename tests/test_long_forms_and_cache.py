"""Long forms of digests, files as of a version, cached responses."""

import random
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from issuelens.operators import outcomes as O
from issuelens.operators import planning as P
from issuelens.operators import prompts as PR
from issuelens.session import scratch_path
from issuelens.sources import repo_files as RF

CHECKS = "run_id long, seq long, kind string, file string, exit_code int, stdout string, stderr string, error string"


def joined(pieces):
    out = {}
    for x in sorted(pieces.collect(), key=lambda r: (r[0] is not None, r[0] or 0, r.piece)):
        text = out.get(x[0])
        assert x.piece == (0 if text is None else joined.n[x[0]] + 1)
        out[x[0]] = x.text if text is None else text + "\n\n" + x.text
        assert out[x[0]][x.offset:] == x.text
        joined.n[x[0]] = x.piece
    return out


joined.n = {}


@pytest.mark.parametrize("rows", [20, 20_000])
def test_error_pieces_are_the_digest(spark, rows):
    """Run 1 holds half of all failures; run None and texts beyond ASCII."""
    r = random.Random(1)
    data = []
    for seq in range(900):
        run = r.choice([1, 1, 2, 3, None])
        data.append((run, seq, r.choice(["test", "lint"]), f"f{seq}.py", r.choice([0, 1, None]), r.choice(["", "é漢", None]),
                     "x\n\ny", r.choice([None, None, "böse"])))
    df = spark.createDataFrame(data, CHECKS)
    want = {x.run_id: x.last_errors for x in O.error_digest(df).collect() if x.last_errors is not None}
    joined.n.clear()
    assert joined(O.error_pieces(df, rows)) == want and len(want) == 4
    assert O.error_pieces(df.limit(0), rows).count() == 0


def test_summary_pieces_are_the_summary(spark):
    files = [(f"r{i % 2}", f"p{i}.py", "0123456789" * (i % 9)) for i in range(120)]
    snap = spark.createDataFrame(files, "repo string, path string, content string")
    changes = spark.createDataFrame([(1, "r0", [p for _, p, _ in files] + ["missing"]), (2, "r1", ["p1.py"]), (3, "r1", []), (4, "r1", None)],
                                    "run_id long, repo string, changed_files array<string>")
    want = {x.run_id: x.summary for x in P.change_summaries(changes, snap, 37).collect()}
    joined.n.clear()
    assert joined(P.summary_pieces(changes, snap, 37, rows=8)) == want and set(want) == {1, 2}


@pytest.mark.parametrize("rows", [10, 20_000])
def test_files_as_of_a_version(spark, rows):
    r = random.Random(3)
    base = {("r", "hot.py"): "old\n", ("r", "b.py"): "b"}
    updates = [("r", r.choice(["hot.py"] * 4 + ["b.py", "new.py"]), r.randint(0, 400), i, r.choice(["", "```\n```", f"text {i}  ", f"```py\nx{i}\n```"]))
               for i in range(1500)] + [("r", "b.py", None, 9999, "no version")]
    asked = [("r", p, v) for p in ("hot.py", "b.py", "new.py", "none.py") for v in [*range(-1, 403, 7), 401]] + [("r", "b.py", 6)] * 3
    clean = lambda t: t.strip().removeprefix("```py\n").removeprefix("```\n").removesuffix("```").strip()
    want = {}
    for repo, path, v in set(asked):
        before = [(ver, seq, clean(t)) for rp, p, ver, seq, t in updates if ver is not None and p == path and ver <= v and clean(t)]
        best = max(before, default=None)
        want[(path, v)] = (best[0], best[2] + "\n") if best else (None, base.get((repo, path)))
    snap = spark.createDataFrame([(*k, c) for k, c in base.items()], "repo string, path string, content string")
    u = spark.createDataFrame(updates, "repo string, path string, version long, seq long, response string")
    q = spark.createDataFrame(asked, "repo string, path string, version long")
    got = RF.file_versions(snap, u, q, rows=rows).collect()
    assert len(got) == len(want) and {(x.path, x.version): (x.content_version, x.content) for x in got} == want
    # The last version is what applying all updates gives.
    applied = {x.path: x.content for x in RF.apply_updates(snap, u.filter("version IS NOT NULL").withColumn("seq", F.col("version") * 10_000 + F.col("seq"))).collect()}
    assert {p: c for (p, v), (_, c) in want.items() if v == max(x for _, _, x in asked) and c is not None} == applied


def test_a_prompt_is_asked_once(spark):
    """The function's answers are new each time it is called."""
    store = scratch_path(spark, "store")

    def ask(p: pd.Series) -> list:
        return [f"{x}|{uuid.uuid4().hex}" for x in p]

    def run(prompts):
        df = spark.createDataFrame([(i, p) for i, p in enumerate(prompts)], "id long, prompt string").repartition(4)
        return {x.id: x.response for x in PR.respond_cached(df, ask, store).collect()}

    def calls():
        return spark.read.parquet(store).count()
    first = run(["a", "b", "a", None, "", "a"])
    assert calls() == 3 and first[0] == first[2] == first[5] and first[0].startswith("a|") and first[3] == "" and first[4].startswith("|")
    again = run(["a", "b", "a", None, "", "a"])
    assert again == first and calls() == 3
    more = run(["c", "b", "é"])
    assert calls() == 5 and more[1] == first[1] and more[2].startswith("é|")
    assert run([]) == {} and calls() == 5
    # Two callers at once may both have written an answer: all readers take the same.
    spark.createDataFrame([(x.prompt_hash, "0") for x in spark.read.parquet(store).collect()], "prompt_hash string, response string") \
        .write.mode("append").parquet(store)
    assert run(["a", "c"]) == {0: "0", 1: "0"}


def test_an_unreadable_store_is_an_error(spark):
    df = spark.createDataFrame([("a",)], "prompt string")
    with pytest.raises(Exception):
        PR.respond_cached(df, lambda p: p, "nosuchscheme://x/y").collect()
