from __future__ import annotations

import random

import pytest

from linewright.functions.predicates import Search
from linewright.sources import ranges
from linewright.streaming import follow


def drain(stream, tmp_path, mode="append", number=None, once=None):
    out = []

    def keep(batch, k):
        batch = number(batch, k) if number else batch
        out.extend((once(batch, k) if once else batch).collect())

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return out


@pytest.fixture
def step(spark, tmp_path):
    """What comes of a path since the last time, by another process each time: its numbered lines."""

    def take(path, **options):
        stream = follow.follow_lines(spark, str(path), state=str(tmp_path / "offsets"), **options)
        rows = drain(stream, tmp_path, number=follow.Numbering(str(tmp_path / "numbers")))
        return [(r.generation, r.line_no, r.text, r.has_lf) for r in sorted(rows, key=lambda r: (r.file_id, r.generation, r.byte_start))]

    return take


def append(path, body: bytes) -> None:
    with path.open("ab") as file:
        file.write(body)


def test_growing_file(step, tmp_path):
    log = tmp_path / "app.log"
    log.write_bytes(b"one\ntwo\nthr")
    assert step(log) == [(0, 0, "one", True), (0, 1, "two", True)]
    # the part of a line comes once, whole, under its own number
    append(log, b"ee\nfour\n")
    assert step(log) == [(0, 2, "three", True), (0, 3, "four", True)]
    assert step(log) == []
    log.write_bytes(b"x\ny\n")
    assert step(log) == [(1, 0, "x", True), (1, 1, "y", True)]
    append(log, b"z\n")
    assert step(log) == [(1, 2, "z", True)]


def test_short_first_lines_and_byte_order_marks(step, tmp_path):
    """A batch that begins at byte 3 is no beginning of a file."""
    plain, marked = tmp_path / "a.log", tmp_path / "b.log"
    got = []
    for a, b in ((b"ab\n", "﻿ab\n".encode()), (b"cd\n", b"cd\n"), (b"ef\n", b"ef\n")):
        append(plain, a)
        append(marked, b)
        got += step(tmp_path / "*.log")
    assert got == [(0, k, t, True) for k, t in enumerate(("ab", "cd", "ef")) for _ in range(2)]


def test_a_file_that_goes_and_comes(step, tmp_path):
    log, other = tmp_path / "in" / "a.log", tmp_path / "in" / "b.log"
    log.parent.mkdir()
    log.write_bytes(b"one\n")
    other.write_bytes(b"o\n")
    assert len(step(log.parent)) == 2
    log.unlink()
    assert step(log.parent) == []
    log.write_bytes(b"one\ntwo\n")
    assert step(log.parent) == [(1, 0, "one", True), (1, 1, "two", True)]


@pytest.mark.parametrize(("encoding", "mark"), [("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff"), ("utf-32-le", b"\xff\xfe\x00\x00"), ("utf-16-le", b"")])
def test_wide_encodings_grow(step, tmp_path, encoding, mark):
    """Growths end within characters; U+0A00 to U+0AFF and U+0D0A hold the byte of an LF."""
    log = tmp_path / "wide.log"
    text = "first plain line\n਀ਊ ഊ\u000d\nÀ😀\nlast\n"
    body = mark + text.encode(encoding)
    cuts = [0, len(mark) + 41, len(mark) + 4 * 13 + 3, len(body)]
    got = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        append(log, body[a:b])
        got += step(log)
    assert got == [(0, k, t, True) for k, t in enumerate(text.split("\n")[:-1])]


def test_flush_and_fail(step, tmp_path):
    log = tmp_path / "app.log"
    log.write_bytes(b"one\ntw")
    assert step(log, flush=True) == [(0, 0, "one", True), (0, 1, "tw", False)]
    append(log, b"o\nthree\n")
    assert step(log, flush=True) == [(0, 1, "o", True), (0, 2, "three", True)]
    log.write_bytes(b"z\n")
    with pytest.raises(Exception, match="FileRewritten"):
        step(log, on_truncate="fail")


def test_a_limit_for_each_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rng = random.Random(1)
    want = {}
    for name in "abc":
        lines = ["x" * rng.randrange(60) for _ in range(300)] + ["long" * 400]
        (folder / name).write_text("".join(f"{t}\n" for t in lines))
        want[name] = list(enumerate(lines))
    sizes, got = [], []
    number = follow.Numbering(str(tmp_path / "numbers"))

    def keep(batch, k):
        rows = number(batch, k).collect()
        sizes.append(sum(r.byte_len + 1 for r in rows if len(r.text) < 1000))
        got.extend((r.file_id[-1], r.line_no, r.text) for r in rows)

    stream = follow.follow_lines(spark, str(folder), max_bytes=6000, range_bytes=500)
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).foreachBatch(keep).start()
    query.processAllAvailable()
    query.stop()
    assert len(sizes) > 3 and max(sizes) <= 6000
    assert {name: sorted(r[1:] for r in got if r[0] == name) for name in "abc"} == want


def test_ranges_cover_every_line_once(tmp_path, monkeypatch):
    log = tmp_path / "a"
    text = "".join(f"line {k} {'é' * (k % 7)}ਊ\n" for k in range(200))
    for encoding in ("utf-8", "utf-16-le", "utf-32-be"):
        log.write_bytes(text.encode(encoding))
        for size, step in ((4, 4), (8, 64), (100, 12), (5000, 1 << 20)):
            monkeypatch.setattr(ranges, "STEP", step)
            reader = follow.GrowingReader({"path": str(log), "range_bytes": str(size), "encoding": encoding.upper().replace("-LE", "LE").replace("-BE", "BE")})
            parts = reader.partitions({}, reader.latestOffset())
            got = [row for part in parts for batch in reader.read(part) for row in batch.to_pylist()]
            assert "".join(r["text"] + "\n" for r in got) == text and [r["byte_start"] for r in got] == sorted(r["byte_start"] for r in got)
            numbers = {}
            for r in got:
                numbers.setdefault(r["range_start"], []).append(r["range_line"])
            assert all(n == list(range(len(n))) for n in numbers.values())


def test_lines_are_numbered_without_a_shuffle(spark, tmp_path):
    """Only counts of ranges are shuffled; lines are read by as many tasks as there are ranges."""
    log = tmp_path / "a.log"
    log.write_text("".join(f"{k}\n" for k in range(20_000)))
    plans, tasks = [], []
    number = follow.Numbering(str(tmp_path / "numbers"))

    def keep(batch, k):
        rows = number(batch, k)
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        tasks.append(rows.rdd.getNumPartitions())
        assert rows.where("text = cast(line_no as string)").count() == 20_000

    stream = follow.follow_lines(spark, str(log), range_bytes=20_000)
    stream.writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    assert "Exchange hashpartitioning" not in plans[0] and "BroadcastHashJoin" in plans[0] and tasks[0] == 6


def test_a_batch_run_again_has_the_same_numbers(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame([(f, g, s, n, s + n, t, len(t), True) for f, g, s, n, t in r], follow.SCHEMA)
    number, once = follow.Numbering(str(tmp_path / "n")), follow.OnceEach(str(tmp_path / "o"))
    shown = lambda df: sorted((r.file_id, r.generation, r.line_no, r.text) for r in df.collect())
    first = rows(("a", 0, 0, 0, "x"), ("a", 0, 0, 1, "y"), ("a", 0, 50, 0, "z"), ("b", 0, 0, 0, "q"))
    assert shown(number(first, 0)) == [("a", 0, 0, "x"), ("a", 0, 1, "y"), ("a", 0, 2, "z"), ("b", 0, 0, "q")]
    more = rows(("a", 0, 60, 0, "u"), ("b", 1, 0, 0, "r"))
    for _ in range(2):
        assert shown(number(more, 1)) == [("a", 0, 3, "u"), ("b", 1, 0, "r")]
    assert shown(number(rows(("b", 1, 9, 0, "s")), 2)) == [("b", 1, 1, "s")]
    with pytest.raises(ValueError, match="after batch 4"):
        number(more, 5)
    # a repeated read, within a batch and from batch to batch
    kept = [sorted(r.text for r in once(batch, k).collect()) for k, batch in enumerate((first.union(first), first.union(more), more))]
    assert kept == [["q", "x", "y", "z"], ["r", "u"], []]
    assert once.state.before(spark, 3).count() == 2


def test_search_and_counts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_text("ERROR a\nfine\n")
    (folder / "b.log").write_text("fine\nERROR b\nerror c\n")
    found = follow.follow_search(follow.follow_new_files(spark, str(folder)), Search("error", ignore_case=True, regex=False))
    assert sorted(r.text for r in drain(found, tmp_path)) == ["ERROR a", "ERROR b", "error c"]
    counts = drain(follow.running_counts(follow.follow_new_files(spark, str(folder)), Search("ERROR")), tmp_path / "two", "complete")
    assert sorted((r.matches, r.processed_lines) for r in counts) == [(1, 2), (1, 3)]
