"""The pipeline stage by stage, and the registered queries with SQL."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from issuelens.llm import op09_language
from issuelens.llm.queries import ORACLE, QUERIES
from tools.check_oracle import duck, rows_of, type_diffs

from ..conftest import SF_SMALL
from .conftest import rows
from .test_operators import fill, given, make, near_by_force


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_equals_sql(spark, key):
    df = QUERIES[key](spark, SF_SMALL)
    res = duck(SF_SMALL).execute(ORACLE[key])
    cols = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(cols) and type_diffs(df.dtypes, res.description) == []
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())


@pytest.mark.parametrize("name", ["edge", "clashing", "empty"])
def test_stages_on_edge_rows(spark, request, name):
    df = request.getfixturevalue(name)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, SF_SMALL)
        if k < 4:
            assert out.columns == df.columns
        out.count()


def test_language_stage_rejects_foreign_scripts_and_noise(spark):
    r = random.Random(4)
    clean = given()
    foreign = ["быстрая лиса прыгает через ленивую собаку " * 8, "η γρήγορη αλεπού πηδά πάνω από το σκυλί " * 8,
               "敏捷的棕色狐狸跳过了懒狗 " * 8]
    noise = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(600)) for _ in range(5)]
    mixed = [clean[0][1][:60] + " " + foreign[0]]
    bad = [(10_000_000 + i, t, None, "s") for i, t in enumerate(foreign + noise + mixed)]
    got = {x["doc_id"] for x in rows(corpus_pipeline.language(spark, make(spark, clean + bad), SF_SMALL))}
    assert not got & {i for i, *_ in bad}
    assert len(got) > 0.95 * len(clean)
    model = op09_language.fit(make(spark, clean))
    (_, score, spans, share, clear), = op09_language.label_texts([foreign[0]], model, 12.0)
    assert (score, share, clear) == (0.0, 0.0, False) and spans.startswith("und:0:")


def test_near_stage_keeps_one_of_each_group(spark):
    docs = given()
    want = near_by_force(docs, k=5)
    got = sorted(r["doc_id"] for r in rows(corpus_pipeline.near_dedup(spark, make(spark, docs), SF_SMALL)))
    assert got == sorted(i for i, (_, c) in want.items() if c == i)


def repeated_rows():
    r = random.Random(6)
    text = [" ".join(r.choice("abcdefghij") * r.randint(1, 5) for _ in range(60)) for _ in range(5)]
    return [(1, text[0], "en", "a")] * 30 + [(None, text[1], "en", "a")] * 20 + [(2, text[2], "en", "b"), (3, text[2], "en", "b")] \
        + [(3, text[3], "en", "b"), (4, text[4], "en", "c")], text


def in_file(spark, tmp_path, docs):
    make(spark, docs).repartition(4).write.parquet(f"{tmp_path}/d")
    return spark.read.parquet(f"{tmp_path}/d")


@pytest.mark.parametrize("files", [False, True])
def test_near_stage_keeps_one_of_repeated_rows(spark, tmp_path, files):
    docs, text = repeated_rows()
    df = in_file(spark, tmp_path, docs) if files else make(spark, docs)
    got = rows(corpus_pipeline.near_dedup(spark, df, SF_SMALL))
    assert sorted((x["doc_id"] or 0, x["text"]) for x in got) == \
        sorted([(1, text[0]), (0, text[1]), (2, text[2]), (3, text[3]), (4, text[4])])


@pytest.mark.parametrize("files", [False, True])
def test_mixing_stage_rounds_repeated_rows_one_by_one(spark, tmp_path, files):
    docs = [(1, "w " * 10, "en", "a")] * 500 + [(2, "w " * 10, "en", "b")] * 300 + [(None, "w " * 10, "en", s) for s in "bccc" * 50]
    df = in_file(spark, tmp_path, docs) if files else make(spark, docs)
    got = Counter(x["source"] for x in rows(corpus_pipeline.mix_sources(spark, df, SF_SMALL)))
    sizes = Counter(s for *_, s in docs)
    for s, target in fill({s: 10 * n for s, n in sizes.items()}).items():
        assert abs(10 * got[s] - target) <= 10, s


def test_mixing_stage_repeats_rows(spark):
    docs = make(spark, given())
    out = corpus_pipeline.mix_sources(spark, docs, SF_SMALL)
    n = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert max(n.values()) == 2 and len(n) < docs.count()
    assert out.join(docs, ["doc_id", "text"], "left_anti").count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.agg(F.max("bin_words")).first()[0] <= 2048 and out.count() > 100
