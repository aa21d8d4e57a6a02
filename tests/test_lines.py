from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from linewright.functions import display
from linewright.functions.encodings import detect
from linewright.functions.predicates import Search
from linewright.functions.spans import byte_to_char_spans, match_spans
from linewright.operators import changes, context, marks, pages, ranks, rules
from linewright.operators import search as s
from linewright.plans import render
from linewright.sources import files
from linewright.sources.tables import lines_from_table


def numbers(df):
    return sorted(r.line_no for r in df.collect())


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first().x


APP = [f"2026-08-07 12:00:00.{i % 1000} INFO  request {i:04} handled" for i in range(100)] + [f"2026-08-07 12:00:05.{i % 1000} ERROR request {i:04} failed retrying" for i in range(10)] + ["2026-08-07 12:00:06.000 INFO  request failed analysis"]


@pytest.fixture
def app(make_lines):
    return make_lines("\n".join(APP) + "\n")


def test_split_rules(make_lines):
    rows = make_lines("one\ntwo\nthree", "a\r\nb\r\n", "", "\n", None).orderBy("file_id", "line_no").collect()
    assert [(r.file_id, r.line_no, r.text, r.byte_len, r.has_lf) for r in rows] == [
        (0, 0, "one", 3, True), (0, 1, "two", 3, True), (0, 2, "three", 5, False), (1, 0, "a\r", 2, True), (1, 1, "b\r", 2, True), (3, 0, "", 0, True)]


def test_corpus_counts(app):
    assert app.count() == 111
    assert s.find(app, Search("ERROR", regex=False)).count() == 10
    assert s.find(app, Search("failed (retrying|analysis)")).count() == 11
    assert s.find(app, Search("info  request 0001", ignore_case=True, regex=False)).count() == 1
    assert numbers(s.find(app, Search("ERROR", start=100, limit=3))) == [100, 101, 102]
    assert s.count_matches(app, Search("ERROR", start=100)).first().matches == 10
    assert [r.text for r in s.tail(app, 2).orderBy("line_no").collect()] == APP[-2:]
    assert s.exists(app, Search("analysis")) and not s.exists(app, Search("zzz"))


def test_find_in_table(spark):
    table = spark.createDataFrame([(1, "a ERROR\nb"), (2, "fine\n"), (3, None), (4, "error\nERR\nOR")], "id long, text string")
    found = s.find_in_table(table, "id", "text", Search("error", ignore_case=True, regex=False))
    assert sorted((r.file_id, r.line_no) for r in found.collect()) == [(1, 0), (4, 0)]
    assert s.find_in_table(table, "id", "text", Search("^b$")).count() == 1


def test_context_output(app):
    near = context.with_context(app, s.find(app, Search("ERROR request 0000", regex=False)), around=1)
    shown = [r.rendered for r in render.render_context(near).orderBy("line_no").collect()]
    assert shown == [f"99-{APP[99]}", f"100:{APP[100]}", f"101-{APP[101]}"]


def test_payload(make_lines):
    rows = make_lines("\n".join(f"line {i:05} payload error" for i in range(10_000)))
    assert s.count_matches(rows, Search("error", regex=False)).first().matches == 10_000
    assert s.count_matches(rows, Search("line 0004", regex=False)).first().matches == 10
    assert s.count_matches(rows, Search("PAYLOAD", ignore_case=True, regex=False, start=5000, end=6000)).first().matches == 1000
    flagged = s.flag_matches(rows, Search("error", regex=False))
    assert ranks.rank(flagged, F.col("is_match")).where("line_no = 1000").first()["rank"] == 1000
    assert ranks.select_k(rows, 9999).first().line_no == 9999
    assert ranks.select_k(rows, 10_000).count() == 0
    # small ranges give the same numbers as one
    assert {(r.line_no, r.p) for r in ranks.running(rows, F.lit(1), "p", range_lines=7).collect()} == {(i, i) for i in range(10_000)}
    assert 99 <= ranks.stride_sample(rows, 100).count() <= 101


def test_fruit_and_folding(make_lines):
    rows = make_lines("apple\nbanana\ncherry\napple\n")
    assert numbers(s.find(rows, Search(["apple", "cherry"], regex=False))) == [0, 2, 3]
    rows = make_lines("École\nÉCOLE\nkelvi\u212a\nx\u0085y\nab\r")
    assert numbers(s.find(rows, Search("école", ignore_case=True, regex=False))) == [0, 1]
    # ASCII needles fold A-Z alone: the Kelvin sign is no k
    assert numbers(s.find(rows, Search("ELVIK", ignore_case=True, regex=False))) == []
    assert numbers(s.find(rows, Search("x.y"))) == [3]
    assert numbers(s.find(rows, Search(r"^\w+$"))) == [0, 1, 2]


@pytest.mark.parametrize("bad", ["(", "a(?=b)", r"(a)\1", "  "])
def test_bad_patterns_are_refused(make_lines, bad):
    with pytest.raises(ValueError):
        s.find(make_lines("x"), Search(bad))


def test_spans(spark):
    t = F.col("text")
    spans = lambda text, search, unit="bytes": [tuple(x) for x in one(spark, match_spans(t, search, unit), text)]
    assert spans("ab ab", Search("ab", regex=False)) == [(0, 2), (3, 5)]
    assert spans("xx ERROR yy ERROR", Search("ERROR")) == [(3, 8), (12, 17)]
    assert spans("😀x", Search("x")) == [(4, 5)]
    assert spans("😀x", Search("x"), "chars") == [(2, 3)]
    assert spans("aéb", Search("x*")) == [(0, 0), (1, 1), (3, 3), (4, 4)]
    assert [tuple(x) for x in one(spark, byte_to_char_spans(t, match_spans(t, Search("l"))), "héllo")] == [(2, 3), (3, 4)]


def test_tabs(spark):
    t = F.col("text")
    assert one(spark, display.expand_tabs(t, 8), "a\tb") == "a       b"
    assert one(spark, display.expand_tabs(t, 8), "1234567\tx") == "1234567 x"
    assert one(spark, display.display_line(t, 0), "ab\r") == "ab"
    span = F.array(F.struct(F.lit(2).alias("start"), F.lit(3).alias("end")))
    assert [tuple(x) for x in one(spark, display.remap_spans(t, span, 4), "a\tb")] == [(4, 5)]
    for text, stop, a, b, want in (("a\tb", 4, 2, 5, (1, 3)), ("a\tb", 4, 0, 1, (0, 1)), ("a\tb", 4, 4, 5, (2, 3)), ("abc", 4, 5, 99, (3, 3)), ("hello", 8, 2, 5, (2, 5))):
        assert tuple(one(spark, display.raw_range(t, F.lit(a), F.lit(b), stop), text)) == want


def test_marks(spark, make_lines):
    key = lambda *n: spark.createDataFrame([(0, i) for i in n], "file_id long, line_no long")
    both = marks.union_pins(key(2, 4, 6, 8), key(5, 4, 1))
    assert numbers(both) == [1, 2, 4, 5, 6, 8]
    assert marks.union_size(key(2, 4, 6, 8), key(5, 4, 1)).first().total == 6
    assert numbers(marks.merge_batches(key(10, 20, 30), key(5, 15), key(1, 2, 3, 100))) == [1, 2, 3, 5, 10, 15, 20, 30, 100]
    assert numbers(marks.restore_pins(key(3, 2, 9, 9))) == [2, 3, 9]
    assert marks.line_at(key(2, 4), key(3), 1).first().line_no == 3
    span = spark.createDataFrame([(0, 4, 6)], "file_id long, first long, last long")
    assert numbers(marks.toggle_pins(key(1, 4), span)) == [1]
    assert numbers(marks.toggle_pins(key(1, 5), span)) == [1, 4, 5, 6]
    assert numbers(marks.unpin(key(1, 5, 7), span)) == [1, 7]


def test_pages(make_lines):
    rows = make_lines("\n".join(["x" * 1000] * 100) + "\n")
    page = pages.page_by_bytes(rows, 0, 10_000)
    assert page.count() == 9
    first = pages.page_by_bytes(rows, 5, 10)
    assert numbers(first) == [5]
    parts = pages.segment_lines(make_lines("y" * (1 << 20)), 1 << 16).orderBy("segment").collect()
    assert len(parts) == 16 and all(len(p.bytes) <= 1 << 16 for p in parts) and parts[-1].done and parts[-1].next_offset == 1 << 20


def test_rules(make_lines):
    rows = make_lines("error: disk\nfine\nerror ERROR")
    made = rules.highlight_spans(rows, [rules.Rule("error", 1), rules.Rule("disk", 2, whole_line=True), rules.Rule("", 9, anchor_line=1, anchor_start=1, anchor_end=3), rules.Rule("", 5)])
    got = {r.line_no: [(x.start, x.end, x.color) for x in r.spans] for r in made.collect()}
    assert got == {0: [(0, 5, 1), (0, 11, 2)], 1: [(1, 3, 9)], 2: [(0, 5, 1), (6, 11, 1)]}
    assert rules.rules_from_selection(rows, 0, 0, 2, 2, 3, 7).count() == 3
    assert rules.rules_from_selection(rows, 0, 1, 0, 1, 0, 7).first().whole_line
    assert rules.rules_from_selection(rows, 0, 0, 7, 0, 11, 7).first().pattern == "disk"


@pytest.mark.parametrize(
    "head,want",
    [(b"\xef\xbb\xbfhi", ("UTF-8", 3)), (b"\xff\xfe\x00\x00", ("UTF-32LE", 4)), (b"\xff\xfea\x00", ("UTF-16LE", 2)), (b"\xfe\xff\x00a", ("UTF-16BE", 2)), (b"\x00\x00\xfe\xff", ("UTF-32BE", 4)),
     ("alpha\nbeta".encode("utf-16-le"), ("UTF-16LE", 0)), ("alpha\nbeta".encode("utf-16-be"), ("UTF-16BE", 0)), ("alpha\nbeta".encode("utf-32-le"), ("UTF-32LE", 0)), (b"\xc4\xe3\xba\xc3", ("GBK", 0)), ("é".encode()[:1], ("UTF-8", 0)), (b"", ("UTF-8", 0))],
)
def test_detection(head, want):
    assert detect(head, "GBK") == want


def read(spark, path, **options):
    rows = files.read_lines(spark, str(path), **options).orderBy("file_id", "line_no").collect()
    return [(r.line_no, r.text, r.byte_start, r.byte_len, r.has_lf) for r in rows]


def test_file_geometry(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"one\ntwo\r\nthree")
    assert read(spark, tmp_path / "a") == [(0, "one", 0, 3, True), (1, "two\r", 4, 4, True), (2, "three", 9, 5, False)]
    (tmp_path / "b").write_bytes(b"\xef\xbb\xbfhello\nworld")
    assert read(spark, tmp_path / "b") == [(0, "hello", 3, 5, True), (1, "world", 9, 5, False)]
    (tmp_path / "c").write_bytes("alpha\nbeta\ngamma".encode("utf-16-le"))
    assert read(spark, tmp_path / "c") == [(0, "alpha", 0, 10, True), (1, "beta", 12, 8, True), (2, "gamma", 22, 10, False)]
    (tmp_path / "d").write_bytes(b"\xff\xfe" + "alpha\nbeta".encode("utf-16-le"))
    assert read(spark, tmp_path / "d") == [(0, "alpha", 2, 10, True), (1, "beta", 14, 8, False)]
    (tmp_path / "e").write_bytes(b"")
    assert read(spark, tmp_path / "e") == []
    (tmp_path / "f").write_bytes(b"ok \xff bad\n")
    assert read(spark, tmp_path / "f", encoding="UTF-8")[0][1] == "ok � bad"
    (tmp_path / "g").write_bytes("你好\n".encode("gbk"))
    assert read(spark, tmp_path / "g", fallback="GBK")[0][:2] == (0, "你好")
    assert files.read_lines(spark, [str(tmp_path / "a"), str(tmp_path / "a"), str(tmp_path / "b")]).count() == 5


@pytest.mark.parametrize("size", [64, 1000, 1 << 20])
def test_numbers_hold_for_any_splits(spark, tmp_path, size):
    rng = random.Random(size)
    want = {}
    for k in range(3):
        texts = ["".join(rng.choice("abé \r") for _ in range(rng.randrange(12))) for _ in range(300)]
        (tmp_path / f"f{k}").write_bytes("\n".join(texts).encode() + b"\n")
        want[f"f{k}"] = texts
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        rows = files.read_lines(spark, str(tmp_path), encoding="UTF-8").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got: dict = {}
    for r in sorted(rows, key=lambda r: r.line_no):
        name = r.file_id.rsplit("/", 1)[1]
        raw = (tmp_path / name).read_bytes()[r.byte_start : r.byte_start + r.byte_len]
        assert raw.decode() == r.text and r.line_no == len(got.setdefault(name, []))
        got[name].append(r.text)
    assert got == want


def test_states(spark, tmp_path):
    path = tmp_path / "log"

    def state(old=None):
        return spark.createDataFrame(files.file_states(files.list_files(spark, str(path)), 16, old).collect(), "file_id string, size long, head_len long, head_hash long, tail_hash long, prefix_hash long")

    path.write_bytes(b"aaaa\n")
    first = state()
    assert changes.change_kind(first, state(first)).first().change == "Unchanged"
    path.write_bytes(b"aaaa\nbbbb\n")
    second = state(first)
    assert changes.change_kind(first, second).first().change == "DataAdded"
    path.write_bytes(b"cccc\n")
    assert changes.change_kind(second, state(second)).first().change == "Truncated"
    path.write_bytes(b"dddd\n" * 9)
    assert changes.change_kind(second, state(second)).first().change == "Truncated"


def test_history_and_pages(spark, app):
    log = spark.createDataFrame([("ERROR", 1), ("warn", 2), ("ERROR", 3), (" ", 4)], "pattern string, at int")
    assert [r.pattern for r in s.history(log, "pattern", "at").collect()] == ["ERROR", "warn"]
    assert s.history(s.forget(log, "pattern", ["ERROR"]), "pattern", "at").count() == 1
    assert [len(b) for b in render.batches(app, 50)] == [50, 50, 11]
    assert numbers(s.next_page(app, (0, 9), 3)) == [10, 11, 12]


def test_context_and_ranks_in_a_table(spark):
    """The same as by joins and windows, without a shuffle; nulls, empty texts, repeated and null ids."""
    rng = random.Random(5)
    texts = ["\n".join(rng.choice(["hit", "a", "", "é hit"]) for _ in range(rng.randrange(1, 30))) + "\n" * rng.randrange(2) for _ in range(60)]
    table = spark.createDataFrame([*enumerate(texts), (100, ""), (101, None), (102, "\n"), (103, "hit")], "id long, text string")
    lines = lines_from_table(table, "id", "text")
    search = Search("hit", regex=False, start=1)
    for sides in ({"before": 2, "after": 1}, {"around": 3}, {}):
        joined = context.with_context(lines, s.find(lines, search), **sides)
        inside = context.context_in_table(table, "id", "text", search, **sides)
        assert inside.columns == [*lines.columns, "is_match"]
        assert sorted(map(tuple, inside.collect())) == sorted(tuple(r[c] for c in inside.columns) for r in joined.collect())
    plan = inside._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Generate") == 1
    ranked = ranks.rank_in_table(table, "id", "text", search)
    by_window = ranks.rank(s.flag_matches(lines, search), F.col("is_match"))
    assert sorted(map(tuple, ranked.collect())) == sorted((r.file_id, r.line_no, r["rank"]) for r in by_window.collect())
    assert "Exchange" not in ranked._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("most", "block"), [(0, 256), (3, 1 << 40), (500_000, 256)])
def test_context_by_join_chooses_ranges(spark, make_lines, monkeypatch, most, block):
    monkeypatch.setattr(context, "BROADCAST_ROWS", most)
    monkeypatch.setattr(context, "BLOCK_LINES", block)
    lines = make_lines("a\nhit\nb\nc\nhit\nd", "x\ny", "hit\nz")
    got = context.with_context(lines, s.find(lines, Search("hit", regex=False)), after=1)
    assert sorted((r.file_id, r.line_no, r.is_match) for r in got.collect()) == [(0, 1, True), (0, 2, False), (0, 4, True), (0, 5, False), (2, 0, True), (2, 1, False)]


def test_many_matches_in_a_line(spark):
    """Sums run in blocks: 100,000 matches take seconds, and every place is right."""
    n = 100_000
    frame = spark.createDataFrame([("a1é" * n,), ("no digits",), (None,), ("7",)], "text string")
    got = [r[0] for r in frame.select(match_spans(F.col("text"), Search("[0-9]"), "chars")).collect()]
    assert [tuple(x) for x in got[0]] == [(3 * k + 1, 3 * k + 2) for k in range(n)]
    assert got[1:] == [[], None, [(0, 1)]]


@pytest.mark.parametrize("size", [3, 1 << 16])
def test_one_file_is_many_keys(spark, make_lines, size):
    """Overview, selections and long tails by ranges of lines, wherever these end."""
    lines = make_lines("\n".join(f"line {k}" for k in range(50)), "a\nb")
    info = s.file_info(lines)
    strip = {(r.file_id, r.bucket): r.n for r in marks.overview(lines, info, 10, size).collect()}
    assert strip == {(0, b): 5 for b in range(10)} | {(1, 0): 1, (1, 5): 1}
    wanted = spark.createDataFrame([(0, 2, 5, 7, 4), (1, 0, None, 9, None)], "file_id long, first int, first_col int, last int, last_col int")
    got = {r.file_id: r.selected for r in pages.selection_text(lines, wanted, range_lines=size).collect()}
    assert got == {0: "2\nline 3\nline 4\nline 5\nline 6\nline", 1: "a\nb"}
    plan = marks.overview(lines, info, 10, size)._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" in plan.split("Join Inner")[1].split("\n")[0]
    long = s.tail(lines, 5000)
    assert long.count() == 52 and "_range" not in long.columns
