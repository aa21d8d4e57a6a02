from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linewright.llm import set_join, vectors
from linewright.llm.components import connected, forest
from linewright.llm.hnsw import Graph

VECTORS = "vec_id long, embedding array<float>, label int, node string, copies int"


def components(pairs):
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, 2000), (7, 7)]
    rows = connected(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()
    want = components([p for p in pairs if p[0] != p[1]])
    assert {r.node: r.component for r in rows} == want and len(rows) == len(want)
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_joins_the_same():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.integers(0, 40, (2, 30))
        low, high = forest(a, b)
        assert len(low) < len(np.unique(np.concatenate([a, b])))
        want, got = components(zip(a.tolist(), b.tolist(), strict=True)), components(zip(low.tolist(), high.tolist(), strict=True))
        assert {k: v for k, v in want.items() if any(x != y for x, y in [(k, v)]) or k in got} == got | {k: v for k, v in want.items() if k in got}


def planted(seed=0, n=400, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[50:90] = x[50] + 0.05 * rng.normal(size=(40, dim))
    x[100:120] = x[100]
    x[200] = -x[201]
    x[130] = 3 * x[131]
    return x.astype(np.float32)


def test_graph_recall():
    x = planted(3, 2000, 24)
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = Graph(x)
    for layer in graph.layers:
        assert all(len(set(n[n >= 0].tolist()) - {k}) == (n >= 0).sum() for k, n in enumerate(layer))  # no repeats, no loops
    found, sims = graph.search(x[:300], 48)
    true = np.argsort(-(x[:300] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(t) & set(f[:48].tolist())) / 10 for t, f in zip(true, found, strict=True)]) > 0.9
    assert all(np.allclose(s[f >= 0], (x[k] @ x[f[f >= 0]].T), atol=1e-5) for k, (f, s) in enumerate(zip(found, sims, strict=True)))


def test_graph_comes_back_from_rows():
    x = planted(8, 700, 12)
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = Graph(x)
    again = Graph.restored(x, graph.placed())
    assert (again.level == graph.level).all() and (again.order == graph.order).all()
    assert all((a == b).all() for a, b in zip(graph.layers, again.layers, strict=True))
    assert all((a == b).all() for a, b in zip(graph.search(x[:50], 16), again.search(x[:50], 16), strict=True))


def test_threshold_is_exact(spark):
    """Cosines of 0.9 as doubles have it link, those below by the last digits don't, and a power
    of two in front changes nothing."""
    a, b = [1.0, 0.0], [0.9, float(np.sqrt(1 - 0.81))]
    below = [0.9 - 1e-13, float(np.sqrt(1 - (0.9 - 1e-13) ** 2))]
    schema = VECTORS.replace("float", "double")
    links = lambda *v: [r.n_links for r in vectors.near_duplicates(spark.createDataFrame([(k, x, 0, "", 0) for k, x in enumerate(v)], schema)).orderBy("vec_id").collect()]
    cosine = lambda u, v: float(np.dot(u, v) / np.sqrt(np.dot(u, u) * np.dot(v, v)))
    assert links(a, b) == [int(cosine(a, b) >= 0.9)] * 2
    assert links(a, below) == [0, 0]
    assert links([x * 2.0**900 for x in a], [x * 2.0**-900 for x in (1.0, 0.1)]) == [1, 1]


@pytest.mark.parametrize("width", [2, 24])
def test_near_duplicates_equal_brute_force(spark, width):
    x = planted()
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [None] + [1.0] * 15), (905, [1.0] * 8), (906, [2.0] * 8), (907, [float("inf")] * 16)]
    rows = [(k, v.tolist(), 1, "n", 2) for k, v in enumerate(x)] + [(k, v, None, None, None) for k, v in odd]
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, VECTORS), width=width, query_rows=150).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    want = components([(i, j) for i, j in zip(*np.nonzero(near), strict=True)] + [(905, 906)])
    assert len(got) == 408
    for k in range(400):
        assert got[k].n_links == near[k].sum() and got[k].component_id == want.get(k, k) and got[k].kept == (want.get(k, k) == k)
    assert got[905].n_links == 1 and got[906].component_id == 905
    assert all(got[k].n_links == 0 and got[k].kept for k in (900, 901, 902, 903, 904, 907))


def test_near_duplicates_edges(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert vectors.near_duplicates(empty).count() == 0 and vectors.top_k(empty).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0], 0, "", 0)] * 3 + [(1, [0.0, 1.0], 0, "", 0)], VECTORS)
    assert sorted((r.n_links, r.component_id) for r in vectors.near_duplicates(twice).collect()) == [(0, 1), (2, 1), (2, 1), (2, 1)]


def test_a_shard_stays_while_queries_pass(spark):
    """However many queries there are, a shard's rows are in one place, or in as many lanes as
    the session's partitions leave idle; every query meets every shard once."""
    frame = spark.createDataFrame([(k, bytes([k % 7, 1])) for k in range(600)], "id long, vec binary")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions, lanes in (("8", 1), ("64", 3)):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        met = vectors._met(frame.withColumn("copies", F.lit(2)), frame, 600, 600, 25, 50).toPandas()
        spark.conf.set("spark.sql.shuffle.partitions", before)
        rows, asked = met[met.asked == 0], met[met.asked == 1]
        assert len(rows) == 600 * lanes and len(asked) == 600 * 24
        assert not rows.duplicated(["id", "lane"]).any() and not asked.duplicated(["id", "shard"]).any()


@pytest.mark.parametrize("cut_at", [1, 7, 1000])
def test_queries_come_beside_their_shard(cut_at):
    """However the batches are cut: a shard is made once, and queries come in bounded parts."""
    want = {(4, 0, 0): (3, 10), (4, 1, 0): (0, 5), (4, 2, 0): (2, 0), (8, 0, 0): (1, 4), (8, 0, 1): (1, 1)}
    rows = [(*key, asked, 100 * n + j) for n, (key, sizes) in enumerate(want.items()) for asked in (0, 1) for j in range(sizes[asked])]
    frame = pd.DataFrame(rows, columns=["dim", "shard", "lane", "asked", "id"])
    made: list = []
    parts = [(shard, list(q["id"])) for shard, q in vectors.beside((frame[k : k + cut_at] for k in range(0, len(frame), cut_at)), lambda f: made.append(list(f["id"])) or list(f["id"]), 4)]
    assert made == [[0, 1, 2], [300], [400]]
    assert parts == [([0, 1, 2], [0, 1, 2, 3]), ([0, 1, 2], [4, 5, 6, 7]), ([0, 1, 2], [8, 9]), ([300], [300, 301, 302, 303]), ([400], [400])]


def found_by(graph, x, y, own, width=16):
    parts = list(vectors.linked(graph, x, y, own, 0.9, width, 96, 0.99))
    return {(int(a), int(b)) for q, r in parts for a, b in zip(q, r, strict=True)}, parts


def unit_rows(rng, n, dim=16):
    x = rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_crowd_comes_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(vectors, "SCAN_PAIRS", 60_000)
    rng = np.random.default_rng(4)
    x = unit_rows(rng, 3000)
    x[:1500] = x[0] + 0.01 * rng.normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    got, parts = found_by(Graph(x.astype(np.float32)), x, x, np.arange(3000))
    want = x @ x.T >= 0.9
    np.fill_diagonal(want, False)
    assert got == set(zip(*(k.tolist() for k in np.nonzero(want)), strict=True)) and len(got) > 2_000_000
    assert max(len(q) for q, _ in parts) <= 256 * 1024 // 3 and sum(len(q) for q, _ in parts) == len(got)


@pytest.mark.parametrize("pairs", [3, 700])
def test_audit_needs_evidence(pairs):
    """A search that finds nothing but the query itself can't pass, with few links or many."""

    class Blind(Graph):
        def search(self, queries, width, block=256):
            sims = queries @ self.vectors.T
            found = sims.argmax(1)[:, None]
            best = np.take_along_axis(sims, found, 1)
            same = best > 0.99999
            return np.where(same, found, -1), np.where(same, best, np.float32(-2))

    rng = np.random.default_rng(6)
    x = unit_rows(rng, 2000)
    x[1000 : 1000 + pairs] = x[:pairs] + 0.02 * rng.normal(size=(pairs, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for rows, own in ((x, np.arange(2000)), (x[:1000], np.where(np.arange(2000) < 1000, np.arange(2000), -1))):
        want = x @ rows.T >= 0.9
        want[own >= 0, own[own >= 0]] = False
        got, _ = found_by(Blind(rows.astype(np.float32)), rows, x, own)
        assert got == set(zip(*(k.tolist() for k in np.nonzero(want)), strict=True)) and len(got) >= pairs


def test_top_k_equals_brute_force(spark):
    x = planted(5, 500)
    x[300:330] = x[20]
    bad = [(1000, None), (1020, [float("nan")] * 16), (1040, [1.0] * 4)]
    frame = spark.createDataFrame([(k, v.tolist(), 1, "n", 2) for k, v in enumerate(x)] + [(k, v, 0, "", 0) for k, v in bad], VECTORS)
    whole = np.floor(64 * x.astype(float)).astype(int)
    got: dict = {}
    for r in vectors.top_k(frame, shard_rows=60, query_rows=9).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 500, 20))
    for q, found in got.items():
        scores = whole @ whole[q]
        best = [k for k in np.lexsort((np.arange(500), -scores)) if k != q][:20]
        assert found == [(n + 1, k, scores[k]) for n, k in enumerate(best)]
    few = frame.where("vec_id < 5")
    assert vectors.top_k(few).count() == 4


def test_maxscore_prunes_and_stays_exact():
    rng = np.random.default_rng(9)
    for scale in (1, 10, 10**6):
        rows = (rng.normal(size=(800, 12)) ** 3 * scale * 20).astype(np.int64)
        lists = vectors.Postings(np.arange(800)[::-1].copy(), rows)
        for q in range(0, 800, 37):
            places, scores = lists.top(lists.rows[q], int(lists.ids[q]), 20)
            exact = [int(sum(int(a) * int(b) for a, b in zip(r, lists.rows[q], strict=True))) for r in lists.rows]
            best = [k for k in sorted(range(800), key=lambda k: (-exact[k], k)) if k != q][:20]
            assert places.tolist() == best and scores.tolist() == [exact[k] for k in best]


def brute_links(texts):
    sets = [set(set_join.shingles(t).tolist()) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return pairs


def corpus(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 6)))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for _ in range(60):
        base = [word() for _ in range(rng.randrange(3, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(copy) // 40)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(rng.choice([" ".join, "  \n".join, ", ".join])(copy))
        texts.append(passage + " " + " ".join(word() for _ in range(rng.randrange(10, 60))))
    return [*texts, "", None, " !? ", "one two", "One, two!", "x " * 3000]


@pytest.mark.parametrize("bucket", [512, 7])
def test_set_join_equals_brute_force(make_docs, monkeypatch, bucket):
    monkeypatch.setattr(set_join, "BUCKET", bucket)
    texts = corpus(bucket)
    pairs = brute_links(texts)
    rows = {r.doc_id: r for r in set_join.similar_documents(make_docs(*enumerate(texts))).collect()}
    links = [0] * len(texts)
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    want = components(pairs)
    assert len(rows) == len(texts)
    for k in range(len(texts)):
        assert (rows[k].n_links, rows[k].component_id, rows[k].kept) == (links[k], want.get(k, k), want.get(k, k) == k)


def test_set_join_shuffled_texts_and_repeats(make_docs, monkeypatch):
    monkeypatch.setattr(set_join, "BROADCAST_ROWS", 0)
    text = " ".join(f"w{k}" for k in range(50))
    docs = make_docs((5, text), (5, text), (None, text), (5, "another text of some more words here"), (9, text + " tail"), (8, "alone among them all it is"))
    rows = sorted((str(r.doc_id), r.n_links, r.component_id, r.kept) for r in set_join.similar_documents(docs).collect())
    assert rows == [("5", 0, 5, True), ("5", 3, 5, True), ("5", 3, 5, True), ("8", 0, 8, True), ("9", 3, 5, False), ("None", 3, 5, False)]
    assert set_join.similar_documents(docs.limit(0)).count() == 0


def test_rows_without_ids_meet_their_own_texts_alone(spark, make_docs, monkeypatch):
    """Of n rows without an id each class's text is read once: n rows of the join, not n times n."""
    met = []
    plain = set_join.with_texts
    monkeypatch.setattr(set_join, "with_texts", lambda *a: met.append(plain(*a)) or met[-1])
    text = lambda k: " ".join(f"{k}x{j}" for j in range(40))
    rows = [(None, text(k) + tail) for k in range(300) for tail in ("", " end")] + [(None, text(0))] * 50 + [(7, text(k)) for k in range(300, 400)]
    got = set_join.similar_documents(make_docs(*rows))
    by = sorted((r.n_links, r["count"]) for r in got.groupBy("n_links").count().collect())
    assert by == [(0, 100), (1, 598), (51, 52)]
    assert met[0].count() <= 600 and met[0].select("node").distinct().count() == met[0].count()


def test_one_path_survives():
    assert set_join.survival() > 0.9 and set_join.runs_for(0.999) >= 3


def test_recall_near_the_threshold(make_docs):
    """Of 500 pairs of a similarity from 0.8 to 0.86 hardly one is missed."""
    rng = random.Random(12)
    rows, pairs = [], 0
    for k in range(500):
        words = [f"{k}x{rng.randrange(10**6)}" for _ in range(260)]
        near = list(words)
        # each changed word changes five of 256 shingles
        for at in rng.sample(range(5, 250, 6), rng.choice([4, 5])):
            near[at] = "y" + near[at]
        a, b = (set(set_join.shingles(" ".join(w)).tolist()) for w in (words, near))
        similarity = len(a & b) / len(a | b)
        if 0.8 <= similarity <= 0.86:
            rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(near))]
            pairs += 1
    found = set_join.similar_documents(make_docs(*rows)).where("n_links = 1").count()
    assert pairs > 300 and found >= 2 * 0.99 * pairs
