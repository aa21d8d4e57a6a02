"""Random lines against line-by-line Python."""

from __future__ import annotations

import random
import re
import time

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linewright.functions.dialect import java_pattern, required, trie
from linewright.functions.predicates import LOWER, UPPER, Search, matches
from linewright.functions.spans import match_spans
from linewright.operators import context, marks, ranks, rules
from linewright.operators import search as s

FOLD = str.maketrans(UPPER, LOWER)
POOL = ["ab", "aB", "é", "É", "ß", "x", " ", "\t", "\r", "1", "😀", "K", ".", "[", "^a", "$"]


def texts(seed: int, n: int = 400) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(POOL) for _ in range(rng.randrange(14))) for _ in range(n)]


SEARCHES = [
    Search("ab", regex=False), Search("AB", ignore_case=True, regex=False), Search(["[", "^a", "é"], regex=False), Search("É", ignore_case=True, regex=False), Search(["x$", "."], regex=False),
    Search("^a"), Search("[0-9x]+"), Search("a(b|B)\\s?x"), Search(["é+", "\\d"]), Search("É", ignore_case=True), Search("(?P<q>x)\\r?$"), Search("\\w{2,}"), Search([f"{c}{d}" for c in "abx1." for d in "abx1."], regex=False),
]


def expected(search: Search, text: str):
    """Spans by Python, in code points."""
    if not search.regex and search.ignore_case and all(p.isascii() for p in search.patterns):
        text, body = text.translate(FOLD), "|".join(regex.escape(p.translate(FOLD)) for p in search.patterns)
        flags = 0
    else:
        body = "|".join(f"(?:{p if search.regex else regex.escape(p)})" for p in search.patterns)
        flags = regex.IGNORECASE if search.ignore_case else 0
    # an end of line is the text's end: CR is content
    return [m.span() for m in regex.finditer(body.replace("$)", r"\Z)") if search.regex else body, text, flags)]


@pytest.mark.parametrize("search", SEARCHES, ids=range(len(SEARCHES)))
def test_matches_and_spans(spark, search):
    rows = texts(hash(search.patterns[0]) % 1000)
    frame = spark.createDataFrame([(t,) for t in rows], "text string")
    got = frame.select("text", matches(F.col("text"), search).alias("hit"), match_spans(F.col("text"), search).alias("spans")).collect()
    for r in got:
        want = expected(search, r.text)
        size = lambda k, t=r.text: len(t[:k].encode())
        assert r.hit == bool(want), (r.text, search)
        assert [tuple(x) for x in r.spans] == [(size(a), size(b)) for a, b in want], (r.text, search)


def test_context_ranks_and_samples(make_lines):
    rng = random.Random(8)
    files = ["\n".join(rng.choice(["x", "y", "z"]) for _ in range(rng.randrange(1, 60))) for _ in range(12)]
    lines = make_lines(*files)
    split = [f.split("\n") for f in files]
    hits = s.find(lines, Search("x", regex=False))
    near = {(f, k) for f, ls in enumerate(split) for k in range(len(ls)) if any(ls[j] == "x" for j in range(max(0, k - 1), min(len(ls), k + 3)))}
    got = context.context_groups(context.with_context(lines, hits, before=2, after=1), range_lines=5).collect()
    assert {(r.file_id, r.line_no) for r in got} == near and all(r.is_match == (split[r.file_id][r.line_no] == "x") for r in got)
    for r in got:
        before = [k for f, k in near if f == r.file_id and k <= r.line_no]
        assert r.starts_group == ((r.file_id, r.line_no - 1) not in near)
        assert r.group_no == sum((r.file_id, k - 1) not in near for k in before) - 1
    ranked = ranks.rank(s.flag_matches(lines, Search("x", regex=False)), F.col("is_match")).collect()
    assert all(r["rank"] == split[r.file_id][: r.line_no].count("x") for r in ranked)
    for k in (0, 2, 7):
        assert {(r.file_id, r.line_no) for r in ranks.select_k(hits, k).collect()} == {(f, [i for i, c in enumerate(ls) if c == "x"][k]) for f, ls in enumerate(split) if ls.count("x") > k}
    sample = {(r.file_id, r.line_no) for r in ranks.stride_sample(hits, 3).collect()}
    assert sample == {(f, i) for f, ls in enumerate(split) for n, i in enumerate([i for i, c in enumerate(ls) if c == "x"]) if n % max(1, ls.count("x") // 3) == 0}
    strip = {(r.file_id, r.bucket): r.n for r in marks.overview(hits, s.file_info(lines), 10).collect()}
    want: dict = {}
    for f, ls in enumerate(split):
        for i, c in enumerate(ls):
            if c == "x":
                want[f, i * 10 // len(ls)] = want.get((f, i * 10 // len(ls)), 0) + 1
    assert strip == want


def test_many_short_rules(spark, make_lines, monkeypatch):
    """Patterns without an inner word, as columns and by their first characters."""
    texts = ["ab cd", "xaby", "c", "", "q\nab", "é!"]
    patterns = ["ab", "a", "c", "d", "!", "é!", "zz", "b c"]
    table = spark.createDataFrame([(k, p, 10 * k, None) for k, p in enumerate(patterns)], "priority int, pattern string, color bigint, anchor_line bigint")
    want = sorted((f, n, k) for f, t in enumerate(texts) for n, line in enumerate(t.split("\n") if t else []) for k, p in enumerate(patterns) if p in line)
    for most in (200, 3):
        monkeypatch.setattr(rules, "MOST_COLUMNS", most)
        got = rules.rules_on_lines(make_lines(*texts), table).collect()
        assert sorted((r.file_id, r.line_no, r.priority) for r in got) == want


def test_patterns_of_the_dialect():
    cases = {
        "a++b": "(?:a+)+b",
        "(ab)*+": "(?:(ab)*)+",
        "x{2}{3}?": "(?:x{2}){3}?",
        "[[:alpha:]_]+": "[[A-Za-z]_]+",
        "[[:^digit:]]": "[[^0-9]]",
        "[]a]": r"[\]a]",
        r"\(?=": r"\(?=",
        "(?P<a_b>x)|(?<c>y)": "(x)|(y)",
        "(?i:A)(?-i)b": "(?i:A)(?-i)b",
        r"[a-z&&[^e]]\d\p{Lu}": r"[a-z&&[^e]]\d\p{Lu}",
        r"\u{E9}\v": r"\x{E9}\x0B",
        "a|+": "a|+",
    }
    assert {p: java_pattern(p) for p in cases} == cases
    for refused in ("(?=a)", "(?<!a)", "(?>a)", r"(a)\1", r"\k<a>", r"\Qa\E", "(?U)a", r"a\Z", "[a--b]", "[a", "a)"):
        with pytest.raises(ValueError):
            java_pattern(refused)


def test_rules_of_a_table(spark):
    texts = ["ERROR: Disk full", "no error here", "élan 42", "ÉLAN", "plain"]
    lines = spark.createDataFrame([(0, k, t) for k, t in enumerate(texts)], "file_id long, line_no long, text string")
    table = [
        (0, "error", None, None, None),
        (1, "error", None, False, None),
        (2, "élan", None, True, None),
        (3, "[0-9]++$", None, None, True),
        (4, "disk full", None, None, False),
        (5, "a DISK b", None, None, False),
        (6, "", 4, None, None),
        (7, " ", None, None, None),
    ]
    rules_table = spark.createDataFrame([(p, t, p * 10, a, i, r) for p, t, a, i, r in table], "priority long, pattern string, color long, anchor_line long, ignore_case boolean, regex boolean")
    want = {(0, 0), (1, 0), (1, 1), (2, 2), (3, 2), (2, 3), (0, 4), (4, 6)}
    assert {(r.line_no, r.priority) for r in rules.rules_on_lines(lines, rules_table).collect()} == want
    # more short literals than are tested as columns
    many = rules_table.unionByName(spark.createDataFrame([(100 + k, f"q{k}", 0, None, None, None) for k in range(rules.MOST_COLUMNS + 1)], rules_table.schema))
    assert {(r.line_no, r.priority) for r in rules.rules_on_lines(lines, many).collect()} == want


def test_groups_and_gaps_across_ranges(spark):
    numbers = [0, 1, 2, 3, 4, 5, 6, 9, 10, 11, 12, 20, 21, 30]
    rows = spark.createDataFrame([(f, n) for f in (1, 2) for n in numbers], "file_id long, line_no long")
    starts = {0: 0, 9: 1, 20: 2, 30: 3}
    for size in (1, 3, 4, 100):
        groups = {(r.file_id, r.line_no): (r.starts_group, r.group_no) for r in context.context_groups(rows, size).collect()}
        assert groups == {(f, n): (n in starts, max(g for s, g in starts.items() if s <= n)) for f in (1, 2) for n in numbers}
        gaps = {(r.file_id, r.line_no): r.gap for r in context.gaps(rows, size).collect()}
        assert gaps == {(f, n): None if k == 0 else n - numbers[k - 1] - 1 for f in (1, 2) for k, n in enumerate(numbers)}
        sums = {(r.file_id, r.line_no): (r.p, r.all) for r in ranks.running(rows, F.lit(1), "p", size, "all").collect()}
        assert sums == {(f, n): (k, len(numbers)) for f in (1, 2) for k, n in enumerate(numbers)}


PARTS = st.sampled_from(["a", "b", "K", "i", "é", "[ab]", ".", "(ab|ba)", "(?:b|K)", "(a(bc)?)", "\\.", "\\d", "^", "$", "|", "ab", " ", "x"])
PATTERNS = st.lists(st.tuples(PARTS, st.sampled_from(["", "", "", "?", "*", "+", "{0,2}", "{2}", "+?"])), min_size=1, max_size=6).map(lambda ps: "".join(p if p in "^$|" else p + q for p, q in ps))


@settings(max_examples=400, deadline=None)
@given(PATTERNS, st.lists(st.text(alphabet="abcKikıéKİ.1 x", max_size=12), max_size=8), st.booleans())
def test_what_matches_need_is_in_them(pattern, texts, ignore_case):
    try:
        compiled = re.compile(pattern, re.IGNORECASE if ignore_case else 0)
        java_pattern(pattern)
    except (re.error, ValueError):
        return
    needed = required(pattern, ignore_case)
    for text in texts:
        if needed and (found := compiled.search(text)):
            held = found.group().translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) if ignore_case else found.group()
            assert any(n in held for n in needed), (pattern, text, needed)


def test_needed_texts():
    assert required("(^|[ ,.])(the|der|les)([ ,.]|$)") == ("the", "der", "les") and required(r"[0-9]+\.[0-9]+") == (".",)
    assert required("ab?c+d") == ("a",)
    assert required("a|b*") is None and required("(?i)abc") is None and required("[0-9]{3,}") is None
    assert required("ERROR .*timeout", True) == ("error ",) and required("Kiss", True) is None


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abé.|", min_size=1, max_size=4), min_size=1, max_size=12), st.lists(st.text(alphabet="abé.|", max_size=9), max_size=8))
def test_tries_find_what_literals_find(literals, texts):
    compiled = regex.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: regex.escape(chr(int(m[1], 16)), special_only=False), trie(literals)))
    assert [bool(compiled.search(t)) for t in texts] == [any(x in t for x in literals) for t in texts]


def test_ten_thousand_needles(spark, make_lines):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(6, 12)))
    lines = [" ".join(word() for _ in range(20)) for _ in range(2000)]
    needles = [word() for _ in range(9_990)] + [x.split()[3] for x in lines[::200]]
    frame = make_lines("\n".join(lines)).cache()
    frame.count()
    took = []
    for few in (needles[-100:], needles):
        began = time.perf_counter()
        got = {r.line_no for r in s.find(frame, Search(few, regex=False)).collect()}
        took.append(time.perf_counter() - began)
    assert got == {k for k, x in enumerate(lines) if any(n in x for n in needles)} and len(got) >= 10
    assert took[1] < 5 + 5 * took[0]


def test_thousands_of_regular_expressions(spark, make_lines, monkeypatch):
    """Rules whose matches hold a text meet its lines; only the others become columns."""
    tested = []
    monkeypatch.setattr(rules, "_tested", lambda lines, listed, plain=rules._tested: tested.append(len(listed)) or plain(lines, listed))
    table = spark.createDataFrame([(k, f"[0-9]+ code{k:04}(x|y)?$", k, None, True, k % 2 == 0) for k in range(5000)] + [(5000, "^[a-z]$", 1, None, True, False)], "priority long, pattern string, color long, anchor_line long, regex boolean, ignore_case boolean")
    lines = make_lines("12 CODE0010x\n7 code0011\n7 CODE0011\nx\n5 code4999y and more\n5 code4998Y", "a\nb1")
    got = {(r.file_id, r.line_no, r.priority) for r in rules.rules_on_lines(lines, table).collect()}
    assert got == {(0, 0, 10), (0, 1, 11), (0, 3, 5000), (0, 5, 4998), (1, 0, 5000)} and tested == [1]


def test_progress_of_a_search(spark, make_lines):
    lines = make_lines("hit\na\nhit", "b\nhit")
    found, progress = s.find_with_progress(lines, Search("hit", regex=False, start=1))
    status = s.search_status(lines, Search("hit", regex=False, start=1)).first()
    assert len(found.collect()) == 2 and found.columns == lines.columns
    assert progress.get == {"matches_found": 2, "processed_lines": 3, "total_lines": 5} == {k: status[k] for k in progress.get}
