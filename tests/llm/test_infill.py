from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from linewright.llm import infill
from linewright.llm.queries import op13_fill_in_middle


def by_hand(doc_id, text: str, rate: int = 100, spm_rate: int = 50) -> tuple:
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    if h4 % 100 < spm_rate:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


ODD = ["", "\n", "\n\n\n", "a", "a\n", "é\n日本\n😀", "x\r\ny\rz", "<P>\n", "a<S>b", "<M", "<P\n>", "  no line\n end", "<<", "<S\nP>\n<", "M>\n<P", "no end " * 3000, "\n" * 5000, "\u0000\n\u0000"]


def test_transform_and_restore(spark, make_docs):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("ab\n\né日😀<P>SM ") for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, "again\nand"), (None, "no\nid\n"), (-7, "below\nzero"), (999, None)]
    docs = make_docs(*rows)
    got = infill.transform(docs)
    made = got.select("*", infill.restored(got["output"], got["form"]).alias("back")).collect()
    assert sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made))) == sorted(repr((i, *by_hand(i, t or ""))) for i, t in rows)
    assert sorted((repr(r.doc_id), r.back) for r in made) == sorted((repr(i), t or "") for i, t in rows)
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    rates = infill.transform(docs, rate=30, spm_rate=10).collect()
    assert sorted((repr(r.doc_id), r.form, r.output) for r in rates) == sorted((repr(i), *np.take(np.array(by_hand(i, t or "", 30, 10), object), [1, 4])) for i, t in rows)
    assert infill.transform(docs.limit(0)).count() == 0


def test_query_equals_a_plain_version(spark, tmp_path, make_docs):
    rows = [(k, t) for k, t in enumerate([*ODD, None])]
    make_docs(*rows).write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {i: (*by_hand(i, t or "")[:4], sha(by_hand(i, t or "")[4]), sha(t or "")) for i, t in rows}
    assert {r[0]: tuple(r)[1:] for r in op13_fill_in_middle(spark, str(tmp_path)).collect()} == want


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=100), st.integers(0, 255))
def test_marks_ranks_and_selects(raw, byte):
    raw = np.frombuffer(raw, np.uint8)
    words = infill.words_of(raw)
    directory = infill.Directory(infill.marked(words, byte))
    places = np.flatnonzero(np.append(raw, np.zeros(len(words) * 8 - len(raw), np.uint8)) == byte)
    assert directory.select(np.arange(len(places))).tolist() == places.tolist()
    at = np.arange(len(raw) + 1)
    assert directory.rank(at).tolist() == [int((raw[:k] == byte).sum()) for k in at]
    assert infill.Directory(infill.going_on(words)).rank(at).tolist() == [int(((raw[:k] & 0xC0) == 0x80).sum()) for k in at]


def test_slices_of_columns():
    texts = pa.array(["skipped\n", "a\nb", "", "é\n\n", "left out"])[1:4]
    cut = infill.cut_lines(texts, np.array([1, 9, 2]), np.array([0, 9, 1]))
    assert {k: v.tolist() for k, v in cut.items()} == {"n": [2, 0, 2], "prefix_bytes": [0, 0, 3], "middle_bytes": [2, 0, 1], "prefix_chars": [0, 0, 2], "middle_chars": [2, 0, 1]}
    assert cut["n"].tolist() == infill.cut_lines(texts.cast(pa.large_string()), np.zeros(3, int), np.zeros(3, int))["n"].tolist()
