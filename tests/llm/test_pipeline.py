from __future__ import annotations

import random

import numpy as np
import pytest
from test_models import TONGUES, speak

import corpus_pipeline
from linewright.llm import set_join

RNG = random.Random(11)


@pytest.fixture(scope="module")
def rows():
    out = []
    for k in range(160):
        text = speak(list(TONGUES)[k % 3], RNG.randrange(30, 120))
        if k % 5 == 0:
            text = RNG.choice([text.upper().replace(" ", "!! "), " ".join([text.split()[0]] * 50)])
        out.append((k, text, list(TONGUES)[k % 3] if k % 7 else None, RNG.choice(["a", "b", None])))
    # copies and near copies, odd texts, a repeated row and a null id
    out += [(200 + k, out[k][1], "aa", "a") for k in (1, 2, 3)]
    out += [(300 + k, out[k][1] + " tail", "bb", "b") for k in (4, 6)]
    out += [(400, None, "aa", "a"), (401, "", "aa", "a"), (402, "123 !!", None, None), (403, out[8][1], "cc", "a"), (403, out[8][1], "cc", "a"), (None, speak("aa"), "aa", "b"), (404, speak("bb", 8000), None, "a")]
    return out


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    full = [(*r, len(r[1] or ""), 7, "kept", 1.5) for r in rows]
    frame = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, copies int, component_id string, score double")
    frame.write.parquet(f"{path}/documents.parquet")
    labels = [(k, int(k % 5 != 0), 0) for k in range(160)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, rows, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder).cache()
        assert out.columns == columns, name
        seen[name] = sorted(map(tuple, out.select("doc_id", "text", "lang", "source").collect()), key=repr)
        docs = out
    # language: no row without a letter stays, all others do, and no language is missing
    letters = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert sorted(str(r[0]) for r in seen["language_id"]) == sorted(str(r[0]) for r in letters)
    assert all(r[2] in TONGUES for r in seen["language_id"])
    # quality: the bad ones go, the clean ones stay
    kept = {r[0] for r in seen["quality_classifier"]}
    assert np.mean([k not in kept for k in range(0, 160, 5)]) > 0.95 and np.mean([k in kept for k in range(160) if k % 5]) > 0.95
    # near duplicates: of each group by brute force just the least id
    texts = {(r[0], r[1]) for r in seen["quality_classifier"]}
    sets = {t: set(set_join.shingles(t[1]).tolist()) for t in texts}
    group = {t: {u for u in texts if len(sets[t] & sets[u]) >= 0.8 * len(sets[t] | sets[u])} for t in texts}
    grown = True
    while grown:
        more = {t: set().union(*(group[u] for u in g)) for t, g in group.items()}
        grown, group = more != group, more
    least = lambda g: min((u for u in g), key=lambda u: (u[0] is None, u[0]))
    assert sorted((r[:2] for r in seen["ngram_jaccard_join"]), key=repr) == sorted({least(g) for g in group.values()}, key=repr)
    # mixing: rows of its input only, three times at most
    left = set(seen["ngram_jaccard_join"])
    assert set(seen["mix_sources"]) <= left and max(seen["mix_sources"].count(r) for r in left) <= 3


def test_run_equals_the_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    key = lambda df: sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, folder)) == key(docs)


def test_empty_table(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


def test_near_duplicates_by_row(spark, make_docs):
    words = lambda name, n=60: " ".join(f"{name}{k}" for k in range(n))
    stays = lambda *rows: sorted(map(repr, (tuple(r) for r in corpus_pipeline.join_near_duplicates(spark, make_docs(*rows), "").select("doc_id", "text").collect())))
    a, b, c, d = map(words, "abcd")
    # a null id that copies a document takes no other null id along
    assert stays((1, a), (None, a), (None, b), (None, c)) == sorted(map(repr, [(1, a), (None, b), (None, c)]))
    # of a repeated id only the near copy goes, and the other text still stands for its group
    assert stays((1, b), (2, a), (2, b + " tail"), (3, a + " tail")) == sorted(map(repr, [(1, b), (2, a)]))
    # near copies of no id: one stays
    assert len(stays((None, a), (None, a + " tail"), (None, a + " end"), (4, d))) == 2
    # of two near texts of the least id one stays, and repeated rows once; wordless rows link with nothing
    assert len(stays((5, a), (5, a + " tail"), (5, a), (6, a), (7, ""), (7, ""), (None, None), (8, ""))) == 4


def test_language_is_predicted_once_a_row(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = corpus_pipeline.identify_language(spark, docs, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_clashing_names(spark, make_docs):
    text = " ".join(f"w{k}" for k in range(40))
    docs = make_docs((1, text), (2, text), (2, text), (3, "other words than those before")).selectExpr("*", "7 AS __id", "8 AS `row`", "9 AS language", "'x' AS id", "5 AS `key`", "6 AS `__language`")
    for stage in (corpus_pipeline.identify_language, corpus_pipeline.join_near_duplicates):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert {tuple(r[-6:]) for r in out.collect()} == {(7, 8, 9, "x", 5, 6)}
