from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from linewright.llm import periodic
from linewright.llm.queries import op11_periodic_runs


def by_hand(words: list, least_words: int = 12) -> list[tuple]:
    """All runs, by looking at every period and place."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        k = 0
        while k + q < n:
            begin = k
            while k + q < n and words[k] == words[k + q]:
                k += 1
            if k - begin >= max(q, least_words - q):
                stretch = words[begin : k + q]
                if not any(q % r == 0 and stretch[r:] == stretch[:-r] for r in range(1, q)):
                    found.append((begin, k + q - begin, q))
            k += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def caught(texts: list[list[int]], **kwargs) -> list[list[tuple]]:
    return [[tuple(r) for r in runs.tolist()] for runs in periodic.find_runs([np.array(t, np.int64) for t in texts], **kwargs)]


small = st.lists(st.integers(0, 2), max_size=60)
repeated = st.tuples(small, st.lists(st.integers(0, 3), min_size=1, max_size=20), st.integers(2, 5), small).map(lambda t: t[0] + t[1] * t[2] + t[3])


@settings(max_examples=300, deadline=None)
@given(st.lists(small | repeated, max_size=6), st.sampled_from([2, 5, 12]))
def test_runs_equal_brute_force(texts, least):
    assert caught(texts, least_words=least) == [by_hand(t, least) for t in texts]


def test_deep_periods_and_words_of_two_letters():
    rng = random.Random(4)
    fibonacci, thue = [0], [0]
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    fibonacci = b
    while len(thue) < 400:
        thue = thue + [1 - x for x in thue]
    texts = [fibonacci, thue, [0] * 400, ([0, 1] * 20 + [2]) * 9, ([0, 1] * 20 + [2] + [0, 1] * 20 + [3]) * 4, [rng.randrange(2) for _ in range(400)], [], [1], list(range(90)) * 3 + [7]]
    texts += [(block := [rng.randrange(9) for _ in range(p)]) * 2 + block[: p // 2] for p in range(6, 130, 5)]
    assert caught(texts) == [by_hand(t) for t in texts]


def test_appending_words_only_adds_or_extends():
    """What is caught in a beginning of a text is caught in the text, there or longer."""
    rng = random.Random(8)
    text = [rng.randrange(3) for _ in range(60)] + [0, 1, 2, 3, 4, 5, 6] * 6 + [rng.randrange(2) for _ in range(60)]
    for n in range(len(text) + 1):
        ends = {(s, q): s + m for s, m, q in caught([text])[0]}
        assert all(ends[s, q] >= s + m and (s + m == n or ends[s, q] == s + m) for s, m, q in caught([text[:n]])[0])


def test_a_misleading_hash_is_noticed(monkeypatch):
    """With a tiny modulus most hashes mislead; what is reported is right all the same."""
    rng = random.Random(1)
    texts = [[rng.randrange(3) for _ in range(20)] + [1, 2, 0] * 5 for _ in range(3)]
    monkeypatch.setattr(periodic, "PRIME", 8191)
    monkeypatch.setattr(np.random, "default_rng", lambda seed, make=np.random.default_rng: _Low(make(seed)))
    assert caught(texts) == [by_hand(t) for t in texts]


class _Low:
    def __init__(self, rng):
        self.rng = rng

    def integers(self, low, high, *size):
        return self.rng.integers(min(low, high - 2), high, *size)


def test_long_texts_take_little_time():
    rng = np.random.default_rng(2)
    n = 500_000
    one, block = np.zeros(n, np.int64), rng.integers(0, 1000, 150_000)
    pairs = np.tile(np.concatenate([np.tile([0, 1], 300), [2]]), n // 601)
    began = time.perf_counter()
    runs = [[tuple(x) for x in r.tolist()] for r in periodic.find_runs([one, np.tile(block, 3), pairs, rng.integers(0, 50, n)])]
    assert runs[0] == [(0, n, 1)] and (0, 450_000, 150_000) in runs[1] and (0, len(pairs), 601) in runs[2]
    assert time.perf_counter() - began < 60


def expected(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = by_hand(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_brute_force(spark, tmp_path, make_docs):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice(["der ", "the\n", "é\t", "x\x0b", "y\x0c\r", " z ", "\x1cq "]) for _ in range(n))
    texts = ["", " \n\t", "one", " lead and trail ", "na " * 500, "a a " * 20, "same line here\n" * 40 + "then others"] + [text(rng.randrange(200)) for _ in range(120)]
    rows = [*enumerate(texts), (None, "a b " * 9), (None, None), (3, "twice " * 13), (5000, None)]
    docs = make_docs(*rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(expected(*r)) for r in rows)
    found = periodic.periodic_runs(docs.where("doc_id = 6")).first()
    assert (found.n_words, found.collapsed) == (122, "same line here then others") and found.runs[0].asDict() == {"start": 0, "length": 120, "period": 3}
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
