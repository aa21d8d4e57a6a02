"""What reviews of the registered queries found, on small tables of odd rows."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from linewright.functions.dialect import after_number
from linewright.operators import rules
from linewright.plans import queries
from linewright.plans.queries import ORACLE_SQL, QUERIES
from linewright.streaming import follow


@pytest.fixture
def against_sql(spark, tmp_path):
    """A query's rows and its SQL's over tables of the given columns."""

    def run(name: str, **tables: dict[str, list]):
        import pyarrow as pa
        import pyarrow.parquet as pq

        db = duckdb.connect()
        for table, columns in tables.items():
            pq.write_table(pa.table(columns), tmp_path / f"{table}.parquet")
            db.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet'")
        got = QUERIES[name](spark, str(tmp_path)).toPandas()
        want = db.sql(ORACLE_SQL[name]).df()
        rows = lambda frame: sorted(tuple(map(str, row)) for row in frame[sorted(want.columns)].itertuples(index=False))
        return rows(got), rows(want)

    return run


def test_letters_that_upper_case_makes_longer(against_sql):
    texts = ["auf schß. und", "SCHSS. x", "ΐ ŉ ǆ", "12 Ab\n7 AB c", "plain"]
    words = ["schß.", "ab", "ΐ", "ŉ", "Ǆ", "AB", "schss."]
    got, want = against_sql("rules_of_all_kinds", documents={"doc_id": list(range(5)), "text": texts}, benchmark={"item_id": list(range(7)), "text": [f"a {w} b" for w in words]})
    assert got == want and len(want) == 9


def test_many_files_of_a_limited_batch(spark, tmp_path):
    """Ranges of many files are read by few tasks, and a batch takes few jobs."""
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(40):
        (folder / f"{k:02}.log").write_text("".join(f"{k} {n}\n" for n in range(100)))
    number, once, tasks, jobs, got = follow.Numbering(str(tmp_path / "n")), follow.OnceEach(str(tmp_path / "o")), [], [], []

    def keep(batch, k):
        tasks.append(batch.rdd.getNumPartitions())
        spark.sparkContext.setJobGroup(f"batch {k}", "")
        rows = number(batch, k)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"batch {k}")))
        got.extend((r.file_id[-6:-4], r.line_no, r.text) for r in once(rows.union(rows), k).collect())

    stream = follow.follow_lines(spark, str(folder), max_bytes=20_000)
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).foreachBatch(keep).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(got) == [(f"{k:02}", n, f"{k} {n}") for k in range(40) for n in range(100)]
    assert len(tasks) > 1 and max(tasks) <= 2 and max(jobs) <= 2


@pytest.mark.parametrize("name", ["follow_growing_files", "follow_wide_files", "follow_rewritten_files"])
def test_followed_files_leave_the_disk(against_sql, spark, monkeypatch, name):
    """Documents are followed in shares, whose files go before the next share's come."""
    monkeypatch.setattr(queries, "SHARES", 2, raising=False)
    monkeypatch.setattr(queries, "AT_ONCE", 1, raising=False)
    monkeypatch.setattr(queries, "SHARE_BYTES", 400, raising=False)
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.rglob("*.log"))
    most = []
    monkeypatch.setattr(queries, "_followed", lambda *a, plain=queries._followed, **b: (plain(*a, **b), most.append(sum(f.stat().st_size for f in set(shared.rglob("*.log")) - before))))
    texts = [f"line {k}\n{'é' * (k % 5)} of {k % 3}\n\nend" * 20 for k in range(60)] + [None, ""]
    got, want = against_sql(name, documents={"doc_id": list(range(62)), "text": texts})
    assert got == want and got
    size = sum(len(t.encode("utf-16-le" if "wide" in name else "utf-8")) for t in texts if t)
    assert not set(shared.rglob("*.log")) - before and max(most) < 1.2 * size
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_few_rules_take_one_pass(spark):
    """Few rules find what many do, by one search of each batch of lines."""
    texts = ["7 the 7the", "the", None, "", "7", " the", "x7 THE", "7 tHE.", "aſk 7 aſk", "Kelvin KELVIN", "ÉA é", "éa", "STRAẞE", "straße a", "b", "ca", "77", "ab", "ab|", "İ ı i I", "7é", "7 thX7 the"]
    lines = spark.createDataFrame([(f % 3, k, t) for f, t in enumerate(texts) for k in (f, f + 100)], "file_id int, line_no long, text string")
    given = [("the", True, False), ("THE", False, False), ("[0-9]+ the", True, True), ("[[:digit:]]{1,2} the", False, True), ("[0-9]+ the?", True, True), ("[0-9]| the", True, True), ("[0-9]ask", True, True), ("[0-9] ask", True, True),
             ("kelvin", True, False), ("éa", True, False), ("éa", False, False), ("straße", True, False), ("bc", True, False), ("a", True, False), ("^$", False, True), ("7{2}", False, True), ("İ", True, False), ("b|", True, False), ("ab|ca", False, True), ("[0-9]é", True, True), (" ", True, False)]
    table = spark.createDataFrame([(k % 18, p, k % 18 * 2, None, i, r) for k, (p, i, r) in enumerate(given)], "priority long, pattern string, color long, anchor_line long, ignore_case boolean, regex boolean")
    more = table.unionByName(spark.createDataFrame([(1000 + k, f"q{k}", 0, None, True, False) for k in range(rules.MOST_COLUMNS)], table.schema))
    few = rules.rules_on_lines(lines, table)
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    found = lambda df: sorted(tuple(r) for r in df.collect())
    assert found(few) == found(rules.rules_on_lines(lines, more)) and len(found(few)) > 60
    assert plan.count("MapInArrow") == 1 and "explode" not in plan
    assert {p: after_number(p, True) for p, _, r in given if r} == {"[0-9]+ the": " the", "[[:digit:]]{1,2} the": " the", "[0-9]+ the?": " th", "[0-9]| the": None, "[0-9]ask": "a", "[0-9] ask": " a", "^$": None, "7{2}": None, "ab|ca": None, "[0-9]é": None}
