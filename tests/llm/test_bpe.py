from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from linewright.llm import bpe, lexicon
from linewright.llm.queries import BYTE_BPE, op12_bpe_codec

ODD = [
    "", " ", "\n\t", "   lead", "trail   ", "a  b   c \n\n d", "Hello World don't I'LL we've 's's''s", "<|endoftext|>", "x <|endoftext|> y  <|endoftext|>z<|endof", "ÀÉ ÎÖ́ ΣΑΣ", "日本語テキスト、です。", "😀😃👩‍👩‍👧", "1234 5.6 7e8 ²³ Ⅷ ٣", "####!!!! ---", "a\x1cb\x1f \x85 ​　x ", "\x00\x01",
    "a" * 3000, " " * 3000 + "x", "=" * 500, "aaaabbbb" * 400, "ing" * 200, "�﻿", "é" * 50,
]


def noise(rng: random.Random, size: int) -> str:
    pools = ["abcdefgh", "ABC xyz", " \n\t   ", "0123.,!?'", "éÉßñΣσς", "日本語", "😀́‍", "'s've'll"]
    return "".join(rng.choice(rng.choice(pools)) if rng.random() < 0.8 else rng.choice(["the", "ing", " <|endoftext|>", "'re", "tion", " of"]) for _ in range(size))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)


def test_merging_equals_the_library(library):
    rng = random.Random(7)
    own = bpe.Encoder(BYTE_BPE)
    texts = ODD + [noise(rng, rng.randrange(150)) for _ in range(1500)]
    ids, n = own.texts(texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_every_character(library):
    """Letters, numbers, white space and the rest are told apart as the library does."""
    own = bpe.Encoder(BYTE_BPE)
    every = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    texts = ["".join(f"a{c}1{c}{c} {c} !{c}" for c in every[k : k + 2000]) for k in range(0, len(every), 2000)]
    ids, _ = own.texts(texts)
    got, at = [], 0
    for e in library.encode_batch(texts, add_special_tokens=False):
        got.append(ids[at : at + len(e.ids)].tolist() == e.ids)
        at += len(e.ids)
    assert all(got)


def test_long_runs_and_cuts(library, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_CHARS", 16)
    rng = random.Random(3)
    own = bpe.Encoder(BYTE_BPE)
    texts = [noise(rng, 400) for _ in range(200)] + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)), " " * 100_000 + "x"]
    ids, n = own.texts(texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


words = st.dictionaries(st.binary(min_size=1, max_size=6).map(lambda b: bytes(x % 4 for x in b)), st.lists(st.integers(0, 5), max_size=4).map(tuple), max_size=40)


@settings(max_examples=150, deadline=None)
@given(words, st.lists(st.binary(max_size=7).map(lambda b: bytes(x % 4 for x in b)), max_size=20))
def test_lexicon_is_a_dictionary(table, others):
    file = lexicon.compiled(sorted(table.items()))
    asked = [*table, *others]
    raw = np.frombuffer(b"".join(asked), np.uint8)
    size = np.array([len(w) for w in asked], np.int64)
    there, n, ids = lexicon.Lexicon(file).find(raw, np.cumsum(size) - size, size)
    assert there.tolist() == [w in table for w in asked]
    assert n.tolist() == [len(table.get(w, ())) for w in asked]
    assert ids.tolist() == [i for w in asked for i in table.get(w, ())]


def test_suffixes_are_shared():
    stems = [f"{a}{b}".encode() for a in "abcdef" for b in "ghijk"]
    rows = lexicon.build(sorted((s + b"ationally", (k,)) for k, s in enumerate(stems)))
    # two levels of stems' letters, then one chain for the ending of all
    assert len(rows) == 1 + 6 + 10 and len(set(rows)) == len(rows)
    with pytest.raises(ValueError, match="byte order"):
        lexicon.build([(b"b", (1,)), (b"a", (2,))])


def test_query_equals_the_library(spark, tmp_path, make_docs, library):
    rng = random.Random(9)
    texts = ODD + [noise(rng, 300) for _ in range(60)] + [" the same words again" * 50] * 3
    rows = [*enumerate(texts), (None, "no id"), (1000, None), (1, "second of its id")]
    make_docs(*rows).write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def by_library(doc_id, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return repr((doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))

    assert sorted(repr(tuple(r)) for r in op12_bpe_codec(spark, str(tmp_path)).collect()) == sorted(by_library(*r) for r in rows)


def test_lexicon_changes_no_id_and_decoding_is_lossy(spark, make_docs, library):
    docs = make_docs(*enumerate(["some words, some more words", "other words" * 3, "some", ""]))
    found = bpe.frequent_words(docs, BYTE_BPE, most=3).collect()
    assert [(r.word, r.n, r.ids) for r in found] == [(w, n, library.encode(w).ids) for w, n in ((" words", 3), (" wordsother", 2), ("some", 2))]
    plain = {r.doc_id: r.ids for r in bpe.encode(docs, BYTE_BPE).collect()}
    assert plain == {r.doc_id: r.ids for r in bpe.encode(docs, BYTE_BPE, bpe.compile_lexicon(docs, BYTE_BPE, most=3)).collect()}
    half = library.encode("é😀").ids[:-1]
    tokens = spark.createDataFrame([(1, half), (2, []), (3, None), (4, [None, 60000, -1, 50256])], "doc_id long, ids array<int>")
    texts = {r.doc_id: r.text for r in bpe.decode(tokens, BYTE_BPE).collect()}
    assert texts == {1: library.decode(half, skip_special_tokens=False), 2: "", 3: None, 4: "<|endoftext|>"}
    empty = docs.limit(0)
    assert bpe.digests(bpe.encode(empty, BYTE_BPE, bpe.compile_lexicon(empty, BYTE_BPE)), BYTE_BPE).count() == 0
