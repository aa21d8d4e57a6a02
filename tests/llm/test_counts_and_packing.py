from __future__ import annotations

import random
import time
import zlib

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from linewright.llm import packing, token_counts
from linewright.llm.queries import BYTE_BPE, BYTE_RANKS, WORD_BPE

ODD = [
    "", " ", "\n\t", "Hello World", "don't you'll we've I'M", "<|endoftext|>x<|startoftext|> <|endof", "ÀÉ ÎÖ ΣΑΣ ΟΔΟΣ", "İstanbul ǅ ﬁ", "e\u0301 \u1e9b\u0323", "a" * 3000, "ab\x1ccd \x85 \u2003 \u200b x", "日本語テキスト、です。", "😀😃 👩‍👩‍👧", "1234 5.6 7e8", "####!!!! ---", "K \u212b",
    "trailing ", "'s's''s", "naïve café", "\u0130\u0131", "x" * 40 + "1" * 40 + "!" * 40,
]


def noise(rng: random.Random, size: int) -> str:
    pools = ["abcdefgh", "ABC xyz", " \n\t\u00a0\u2028", "0123.,!?'", "éÉßñΣσς", "日本語", "😀\u0301\u200d", "<|endoftext|>", "'s've'll"]
    return "".join(rng.choice(rng.choice(pools)) if rng.random() < 0.9 else rng.choice(["the", "ing", "<|endoftext|>", "'re", "tion"]) for _ in range(size))


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORD_BPE)


def test_transducer_equals_the_library(word_library):
    rng = random.Random(7)
    count = token_counts.Counter(WORD_BPE)
    for text in ODD + [noise(rng, rng.randrange(120)) for _ in range(1500)]:
        assert count.text(text) == len(word_library.encode(text, add_special_tokens=False).ids), repr(text)


def test_long_runs_take_linear_time(word_library, monkeypatch):
    """Unbroken runs, random or of few letters, are read in stretches; tables stay bounded."""
    monkeypatch.setattr(token_counts, "MAX_STATES", 5000)
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    run = lambda pool, n: "".join(rng.choice(pool) for _ in range(n))
    count = token_counts.Counter(WORD_BPE)
    began = time.perf_counter()
    texts = [run(letters, 250_000), run("acgt", 60_000), run("ab", 60_000), "a" * 60_000, "ab" * 30_000 + "c", ("ab" * 300 + "cd") * 100, "é" * 30_000, "=-" * 20_000, run(letters, 1025), run(letters, 1024), " ".join(run(letters, 900) for _ in range(40))]
    got = [count.text(t) for t in texts]
    assert time.perf_counter() - began < 60
    assert got == [len(e.ids) for e in word_library.encode_batch(texts, add_special_tokens=False)]
    assert len(count.transducer.number) <= 5000 + token_counts.LANES and len(count.transducer.quick) <= 5001


def test_stretches_equal_a_plain_reading():
    rng = random.Random(2)
    count = token_counts.Counter(WORD_BPE).transducer
    for pool, n in (("abcdefgh", 3000), ("ab", 3000), ("a", 2500), ("the", 4000)):
        raw = "".join(rng.choice(pool) for _ in range(n)).encode()
        state, had = count._one_by_one(0, np.frombuffer(raw[:7], np.uint8).astype(np.int64))
        after, tokens = count.read(state, raw[7:])
        assert (count.key(after), had + tokens) == (lambda s, t: (count.key(s), t))(*count._one_by_one(0, np.frombuffer(raw, np.uint8).astype(np.int64)))


def test_chunks_compose(word_library):
    """Chunks' maps, evaluated at the states that occur, give the count of the whole text."""
    rng = random.Random(3)
    count = token_counts.Counter(WORD_BPE)
    for _ in range(400):
        text = noise(rng, rng.randrange(300))
        edges = sorted({p for p in (count.cut_at(text, rng.randrange(len(text) + 1)) for _ in range(rng.randrange(6))) if p is not None})
        state, total = token_counts.START, 0
        for a, b in zip([0, *edges], [*edges, len(text)], strict=True):
            state, tokens = count.evaluate(state, *count.element(text[a:b]))
            total += tokens
        assert total + count.end(state) == count.text(text) == len(word_library.encode(text, add_special_tokens=False).ids), repr(text)


def test_maps_compose_in_any_bracketing():
    rows = [(0, b"", b"a", 1), (1, b"", b"x", 9), (1, b"a", b"b", 2), (2, b"b", b"c", 3), (2, b"x", b"c", 5), (3, b"c", b"", 4)]
    frame = pd.DataFrame(rows, columns=["part", "before", "after", "tokens"])
    assert token_counts.composed(frame)[b""] == (b"", 10)
    halves = [token_counts.composed(frame[frame["part"] < 2]), token_counts.composed(frame[frame["part"] >= 2])]
    after, tokens = halves[0][b""]
    assert (halves[1][after][0], tokens + halves[1][after][1]) == (b"", 10)


def test_states_restart_without_effect(monkeypatch, word_library):
    monkeypatch.setattr(token_counts, "MAX_STATES", 5)
    monkeypatch.setattr(token_counts, "LANES", 3)
    monkeypatch.setattr(token_counts, "LONG_RUN", 300)
    count = token_counts.Counter(WORD_BPE)
    for text in ODD:
        assert count.text(text) == len(word_library.encode(text, add_special_tokens=False).ids)


def test_texts_without_white_space(make_docs, word_library):
    """Chunks that are one run, whose maps depend on what came before; and places that allow no cut."""
    rng = random.Random(9)
    texts = ["a" * 7001, "ab" * 4003, "".join(rng.choice("etaoinshrdlu") for _ in range(9000)), "!?" * 4000, "日本語" * 2500, "x" + "\u0301\u0323" * 3000 + "y", "'" * 5000, "é1" * 3000, "<|endoftext|>" * 700]
    rows = token_counts.token_counts(make_docs(*enumerate(texts)), WORD_BPE, chunk_chars=1000).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {k: len(word_library.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}


def test_token_counts_query(make_docs, word_library):
    texts = [*ODD, None, "word " * 5000, "long" * 3000]
    docs = make_docs(*[(k % 20, t) for k, t in enumerate(texts)], (None, "null id"))
    rows = token_counts.token_counts(docs, WORD_BPE, chunk_chars=997).collect()
    want = sorted((str(k % 20), len((t or "").encode()), len(word_library.encode(t or "", add_special_tokens=False).ids)) for k, t in enumerate(texts))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows if r.doc_id is not None)
    assert got == want and len(rows) == len(texts) + 1
    assert all(r.over_limit == (r.n_tokens > 2048) for r in rows)
    assert token_counts.token_counts(docs.limit(0), WORD_BPE).count() == 0


def test_pieces_equal_the_library(make_docs):
    library = Tokenizer.from_file(BYTE_BPE)
    rng = random.Random(5)
    texts = ODD + [noise(rng, 80) for _ in range(300)] + ["word " * 4000, "x<|endoftext|>" * 900]
    docs = make_docs(*enumerate(texts), (1000, None))
    pieces: dict = {}
    for r in packing.pack_documents(docs, BYTE_BPE, BYTE_RANKS).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for k, text in [*enumerate(texts), (1000, "")]:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        own = sorted(pieces[k], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert sum(r.length for r in own) == len(ids) and all(r.length == 1024 for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_long_runs_equal_the_library():
    library = Tokenizer.from_file(BYTE_BPE)
    encode = packing.encoder(BYTE_BPE, BYTE_RANKS)
    n = 1_000_000
    for text in ("x" + " " * n, "x" + " " * n + "y", "\n" * n + "1", " " * n + "<|endoftext|>" + "\n \t" * (n // 3) + "!", "a" * n, "#" * n, "x" + "\u2003 " * (n // 2) + "\n'll", "z" + "\n" * n + " w"):
        assert packing.token_ids(encode, text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text[:3] + text[-3:])
    for unit in " \n":
        # the ids of a run of this length are too many for the library's memory here; they come back as the text
        text = "x" + unit * 10 * n + "y"
        ids = packing.token_ids(encode, text)
        assert encode.decode(ids.tolist()) == text


def test_sequences_are_gapless_and_few(spark):
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1025, 3000)
    frame = spark.createDataFrame([(k, 0, 0, int(n), 0) for k, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    # repeated rows are placed once each
    rows = packing.pack(frame.union(frame.limit(10)), group_pieces=10_000).collect()
    assert len(rows) == 3010
    used: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 1024 and len(used) <= 1.02 * sum(used.values()) / 1024 + 2


def test_packing_picks_the_least_squares():
    # one open bin of gap 5, one of gap 4: a 4 fills the one, a 3 goes where squares are least
    bins, offsets = packing.pack_sizes(np.array([5, 6, 4, 5]), 10)
    assert bins.tolist() == [0, 1, 1, 0] and offsets.tolist() == [0, 0, 6, 5]
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 20, 60)
    bins, _ = packing.pack_sizes(sizes, 20)
    open_: dict[int, int] = {}
    for size, where in zip(sizes.tolist(), bins.tolist(), strict=True):
        squares = lambda o: sum(np.bincount([g for g in o.values() if g]).astype(int) ** 2) if any(o.values()) else 0
        tried = [squares(open_ | {b: g - size}) for b, g in open_.items() if g >= size]
        new = where not in open_
        assert new == (not tried)
        after = open_ | {where: (20 if new else open_[where]) - size}
        assert new or squares(after) == min(tried)
        open_ = after


def test_whole_sequences(make_docs):
    docs = make_docs((1, "a b c"), (2, "word " * 1500), (3, None))
    rows = packing.sequences(docs, BYTE_BPE, BYTE_RANKS).collect()
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    total = sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for t in ("a b c", "word " * 1500, ""))
    assert sum(len(r.ids) for r in rows) == total
    assert sorted((d.doc_id, d.piece) for r in rows for d in r.documents)[0] == (1, 0)
    assert packing.pack_documents(docs.limit(0), BYTE_BPE, BYTE_RANKS).count() == 0
