"""The registered queries of the line engine, each beside its SQL.

Most run over `documents`, whose texts are files of lines; `conversations` (turns as lines),
`pages` (long lines), `labels` (pinned lines) and `events` (a search log) serve the rest.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.java_gateway import ensure_callback_server_started
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.checkpoints import cut, shared_folder
from linewright.functions import display
from linewright.functions.encodings import encoding_name
from linewright.functions.predicates import Search
from linewright.functions.spans import ansi, byte_to_char_spans, match_spans
from linewright.operators import changes, context, marks, pages, ranks, rules
from linewright.operators import search as s
from linewright.plans import render
from linewright.sources import files
from linewright.sources.stores import listed, open_file, store_of
from linewright.sources.tables import lines_from_rows, lines_from_table
from linewright.streaming import follow

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The lines of documents, for DuckDB.
LINES = """l AS (SELECT file_id, unnest(ls) AS text, unnest(range(len(ls))) AS line_no, len(ls) AS n, lf FROM (
  SELECT doc_id AS file_id, suffix(text, chr(10)) AS lf, string_split(CASE WHEN suffix(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS ls
  FROM documents WHERE text <> ''))"""
NEEDLE = Search("license", ignore_case=True, regex=False)
HIT = "contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'license')"
WORD = Search("(^|[ ,.])(the|der|les)([ ,.]|$)", regex=True)
WORD_HIT = "regexp_matches(text, '(^|[ ,.])(the|der|les)([ ,.]|$)')"
TABBED = "replace(text, '. ', chr(9))"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_from_table(docs(spark, sf_dir), "doc_id", "text")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_from_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "text")


def searched(spark: SparkSession, sf_dir: str, search: Search) -> DataFrame:
    return s.find_in_table(docs(spark, sf_dir), "doc_id", "text", search)


def html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_from_table(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html")


def pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh line is pinned."""
    return lines(spark, sf_dir).where("line_no % 7 = 0").select("file_id", "line_no")


def tabbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).withColumn("text", F.replace("text", F.lit(". "), F.lit("\t")))


def query(sql: str | None = None, prefix: str = LINES) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH {prefix}{sql}" if prefix else sql
        return f

    return add


def keyed(df: DataFrame, *more: str) -> DataFrame:
    return df.select("file_id", "line_no", *more)


# lines, files


@query(" SELECT file_id, line_no, text, strlen(text) AS byte_len, (line_no < n - 1 OR lf) AS has_lf FROM l")
def line_numbering(spark, sf):
    return lines(spark, sf).select("file_id", "line_no", "text", "byte_len", "has_lf")


@query(" SELECT file_id, count(*) AS line_count, max(strlen(text)) AS max_line_len, CAST(sum(strlen(text) + CAST(line_no < n - 1 OR lf AS INT)) AS BIGINT) AS size FROM l GROUP BY file_id")
def file_info(spark, sf):
    return s.file_info(lines(spark, sf))


@query(" SELECT file_id, '{\"path\":\"' || file_id || '\",\"size\":' || CAST(sum(strlen(text) + CAST(line_no < n - 1 OR lf AS INT)) AS BIGINT) || ',\"line_count\":' || count(*) || ',\"max_line_len\":' || max(strlen(text)) || '}' AS json FROM l GROUP BY file_id")
def info_json(spark, sf):
    return render.info_json(s.file_info(lines(spark, sf)))


@query(" SELECT file_id, line_no, text FROM (SELECT *, max(line_no) OVER (PARTITION BY file_id) AS last FROM l) WHERE line_no > last - 10")
def tail_n(spark, sf):
    return keyed(s.tail(lines(spark, sf), 10), "text")


@query(" SELECT file_id, line_no, text FROM l WHERE line_no >= 3 AND line_no < 8")
def read_range(spark, sf):
    return keyed(s.read_range(lines(spark, sf), 3, 5), "text")


@query(" SELECT file_id, line_no, text FROM l WHERE line_no = least(11, n - 1)")
def go_to_line(spark, sf):
    return keyed(s.go_to_line(lines(spark, sf), 12, clamp=True), "text")


# predicates


@query(f" SELECT file_id, line_no, text FROM l WHERE {HIT}")
def search_ignore_case(spark, sf):
    return keyed(searched(spark, sf, NEEDLE), "text")


@query(" SELECT file_id, line_no, text FROM l WHERE contains(text, 'the ')")
def search_literal(spark, sf):
    return keyed(searched(spark, sf, Search("the ", regex=False)), "text")


@query(" SELECT file_id, line_no, text FROM l WHERE contains(replace(text, 'É', 'é'), 'éle')")
def search_unicode_ignore_case(spark, sf):
    # only É and é fold; l and e are ASCII on both sides of the comparison
    return keyed(s.find(lines(spark, sf), Search("[Éé]le", regex=True)), "text")


@query(" SELECT file_id, line_no, text FROM l WHERE contains(lower(text), 'éau')")
def search_folded(spark, sf):
    return keyed(searched(spark, sf, Search("ÉAU", ignore_case=True, regex=False)), "text")


@query(" SELECT file_id, line_no, text FROM l WHERE contains(text, 'License') OR contains(text, '@') OR contains(text, 'http')")
def search_multi_literal(spark, sf):
    return keyed(searched(spark, sf, Search(["License", "@", "http"], regex=False)), "text")


@query(", v AS (SELECT DISTINCT lower(list_extract(string_split(text, ' '), 3)) || ' ' AS word FROM benchmark) SELECT DISTINCT file_id, line_no, text FROM l JOIN v ON contains(l.text, v.word) WHERE length(word) > 3")
def search_thousands_of_literals(spark, sf):
    """Needles from a table, as one expression that branches by their characters."""
    word = F.concat(F.lower(F.get(F.split("text", " "), 2)), F.lit(" "))
    needles = [r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select(word.alias("w")).where(F.length("w") > 3).distinct().collect()]
    return keyed(searched(spark, sf, Search(needles, regex=False)), "text").distinct()


@query("".join([" SELECT file_id, line_no, text FROM l WHERE ", " OR ".join(f"contains(text, '{chr(97 + k)}{chr(98 + k)}')" for k in range(20))]))
def search_many_literals(spark, sf):
    return keyed(searched(spark, sf, Search([f"{chr(97 + k)}{chr(98 + k)}" for k in range(20)], regex=False)), "text")


@query(r" SELECT file_id, line_no, text FROM l WHERE regexp_matches(text, '[0-9]{3,}')")
def search_regex(spark, sf):
    return keyed(searched(spark, sf, Search("[0-9]{3,}")), "text")


@query(r" SELECT file_id, line_no, text FROM l WHERE regexp_matches(text, '(?:[0-9]+\.[0-9]+)|(?:^Th[a-z]+ )')")
def search_multi_regex(spark, sf):
    return keyed(searched(spark, sf, Search([r"[0-9]+\.[0-9]+", "^Th[a-z]+ "])), "text")


@query(r" SELECT file_id, line_no, text FROM l WHERE regexp_matches(text, '(?i)lic[a-z]+ed?')")
def search_regex_ignore_case(spark, sf):
    return keyed(searched(spark, sf, Search("lic[a-z]+ed?", ignore_case=True)), "text")


@query(" SELECT file_id, line_no, text FROM l WHERE contains(text, 'the ') AND line_no >= 2 AND line_no < 6")
def search_line_range(spark, sf):
    return keyed(searched(spark, sf, Search("the ", regex=False, start=2, end=6)), "text")


@query(" SELECT file_id, line_no, text FROM l WHERE contains(text, 'the ') AND line_no >= 9")
def search_from_offset(spark, sf):
    return keyed(searched(spark, sf, Search("the ", regex=False, start=9)), "text")


@query(f" SELECT file_id, line_no, {HIT} AS is_match FROM l")
def match_flag(spark, sf):
    return keyed(s.flag_matches(lines(spark, sf), NEEDLE), "is_match")


@query(r" SELECT conv_id AS file_id, turn AS line_no, text FROM conversations WHERE regexp_matches(text, '(an|er|en) ')", prefix="")
def conversation_search(spark, sf):
    return keyed(s.find(turns(spark, sf), Search("(an|er|en) ")), "text")


# order, limits, pages


@query(f" SELECT file_id, line_no, text FROM l WHERE {HIT} ORDER BY file_id, line_no")
def ordered_matches(spark, sf):
    return keyed(s.ordered(searched(spark, sf, NEEDLE)), "text")


@query(" SELECT file_id, line_no, text FROM l WHERE contains(text, 'the ') ORDER BY file_id, line_no LIMIT 25")
def first_n(spark, sf):
    return keyed(searched(spark, sf, Search("the ", regex=False, limit=25)), "text")


@query(" SELECT file_id, line_no, text FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS k FROM l WHERE contains(text, 'the ')) WHERE k <= 2")
def first_n_of_each(spark, sf):
    return keyed(s.first_n_of_each(searched(spark, sf, Search("the ", regex=False)), 2), "text")


@query(" SELECT file_id, line_no, text FROM l WHERE contains(text, 'the ') AND (file_id > 40 OR (file_id = 40 AND line_no > 2)) ORDER BY file_id, line_no LIMIT 100")
def result_page(spark, sf):
    return keyed(s.next_page(searched(spark, sf, Search("the ", regex=False)), (40, 2), 100), "text")


@query(", p AS (SELECT DISTINCT doc_id AS file_id, 0 AS line_no FROM labels WHERE toxic = 1) SELECT l.file_id, l.line_no, l.text FROM l JOIN p ON l.file_id = p.file_id AND l.line_no = p.line_no")
def fetch_lines(spark, sf):
    wanted = spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").select(F.col("doc_id").alias("file_id"), F.lit(0).cast("long").alias("line_no"))
    return keyed(s.fetch(lines(spark, sf), wanted), "text")


@query(" SELECT event_type AS pattern, max(ts) AS last_used FROM events WHERE trim(event_type) <> '' GROUP BY event_type ORDER BY last_used DESC, pattern LIMIT 20", prefix="")
def history_topk(spark, sf):
    return s.history(spark.read.parquet(f"{sf}/events.parquet"), "event_type", "ts", 20)


@query(" SELECT pattern, max(used) AS last_used FROM (SELECT list_extract(string_split(text, ' '), 1) AS pattern, conv_id * 1000 + turn AS used FROM conversations) WHERE trim(pattern) <> '' GROUP BY pattern ORDER BY last_used DESC, pattern LIMIT 20", prefix="")
def history_of_words(spark, sf):
    """More distinct patterns than the history keeps."""
    log = spark.read.parquet(f"{sf}/conversations.parquet").select(F.get(F.split("text", " "), 0).alias("word"), (F.col("conv_id") * 1000 + F.col("turn")).alias("at"))
    return s.history(log, "word", "at", 20)


@query(
    """p AS (SELECT page_id AS file_id, unnest(ls) AS text, unnest(range(len(ls))) AS line_no FROM (SELECT page_id, string_split(CASE WHEN suffix(html, chr(10)) THEN left(html, length(html) - 1) ELSE html END, chr(10)) AS ls FROM pages WHERE html <> '')),
 b AS (SELECT file_id, line_no, strlen(text) AS size, hex(encode(text)) AS h FROM p),
 o AS (SELECT *, unnest(range(0, greatest(size - 1, 0) + 1, 256)) AS byte_offset FROM b)
 SELECT file_id, line_no, byte_offset // 256 AS segment, byte_offset, lower(substring(h, 2 * byte_offset + 1, 512)) AS bytes, least(byte_offset + 256, size) AS next_offset, byte_offset + 256 >= size AS done FROM o""",
    prefix=" ",
)
def segment_long_lines(spark, sf):
    return pages.segment_lines(html(spark, sf), 256).withColumn("bytes", F.lower(F.hex("bytes")))


@query(
    """, b AS (SELECT *, sum(strlen(text) + CAST(line_no < n - 1 OR lf AS INT)) OVER (PARTITION BY file_id ORDER BY line_no) AS upto FROM l WHERE line_no >= 1)
 SELECT file_id, line_no, text FROM b WHERE upto <= 2000 OR line_no = 1"""
)
def page_by_bytes(spark, sf):
    return keyed(pages.page_by_bytes(lines(spark, sf), 1, 2000), "text")


@query(
    """, m AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_no) - 1 AS k, count(*) OVER (PARTITION BY file_id) AS c FROM l WHERE contains(text, 'e'))
 SELECT file_id, line_no FROM m WHERE k % greatest(1, c // 3) = 0"""
)
def stride_sample(spark, sf):
    return keyed(ranks.stride_sample(s.find(lines(spark, sf), Search("e", regex=False)), 3))


# counts


@query(f" SELECT file_id, CAST(sum(CAST({WORD_HIT} AS INT)) AS BIGINT) AS matches, count(*) AS processed_lines FROM l GROUP BY file_id")
def count_matches(spark, sf):
    return s.count_matches(lines(spark, sf), WORD)


@query(f" SELECT file_id, bool_or({HIT}) AS found FROM l GROUP BY file_id")
def exists_match(spark, sf):
    return s.exists_by_file(lines(spark, sf), NEEDLE)


@query(f" SELECT count(*) FILTER (WHERE line_no >= 1 AND {HIT}) AS matches_found, count(*) FILTER (WHERE line_no >= 1) AS processed_lines, count(*) AS total_lines, true AS done FROM l")
def search_status(spark, sf):
    return s.search_status(lines(spark, sf), Search("license", ignore_case=True, regex=False, start=1))


@query(f" SELECT count(*) FILTER (WHERE line_no >= 1 AND {HIT}) AS matches_found, count(*) FILTER (WHERE line_no >= 1) AS processed_lines, count(*) AS total_lines FROM l")
def search_progress(spark, sf):
    """What a search counted while its matches were written."""
    found, progress = s.find_with_progress(lines(spark, sf), Search("license", ignore_case=True, regex=False, start=1))
    found.write.parquet(_folder(spark))
    return spark.createDataFrame([(progress.get["matches_found"], progress.get["processed_lines"], progress.get["total_lines"])], "matches_found long, processed_lines long, total_lines long")


@query(f" SELECT file_id, CAST(floor(line_no * 40 / n) AS BIGINT) AS bucket, count(*) AS n FROM l WHERE {WORD_HIT} GROUP BY ALL".replace("n) AS BIGINT", "CAST(n AS DOUBLE)) AS BIGINT"))
def overview_strip(spark, sf):
    every = lines(spark, sf)
    return marks.overview(s.find(every, WORD), s.file_info(every), 40)


@query(" SELECT file_id, greatest(0, least(CAST(floor(13 / 40.0::DOUBLE * max(n)) AS BIGINT), max(n) - 1)) AS line_no FROM l GROUP BY file_id")
def line_of_strip_place(spark, sf):
    return marks.line_of_place(s.file_info(lines(spark, sf)), 13, 40)


@query(" SELECT file_id, CASE WHEN size >= 1048576 THEN printf('%.1f MiB', size / 1048576.0) WHEN size >= 1024 THEN printf('%.1f KiB', size / 1024.0) ELSE size || ' B' END AS shown FROM (SELECT file_id, CAST(sum(strlen(text) + CAST(line_no < n - 1 OR lf AS INT)) AS BIGINT) AS size FROM l GROUP BY file_id)")
def human_bytes(spark, sf):
    return s.file_info(lines(spark, sf)).select("file_id", display.human_bytes(F.col("size")).alias("shown"))


@query(
    """, p AS (SELECT *, CASE WHEN line_no = 1 THEN substring(text, 3) WHEN line_no = 4 THEN left(text, 12) ELSE text END AS piece FROM l WHERE line_no BETWEEN 1 AND 4),
 r AS (SELECT *, sum(length(piece) + 1) OVER (PARTITION BY file_id ORDER BY line_no) - 1 AS upto FROM p)
 SELECT file_id, CASE WHEN bool_or(upto > 500) AND count(*) FILTER (WHERE upto <= 500) > 0 THEN string_agg(piece, chr(10) ORDER BY line_no) FILTER (WHERE upto <= 500) || chr(10) ELSE coalesce(string_agg(piece, chr(10) ORDER BY line_no) FILTER (WHERE upto <= 500), '') END AS selected,
 bool_or(upto > 500) AS truncated FROM r GROUP BY file_id"""
)
def selection_text(spark, sf):
    wanted = docs(spark, sf).select(F.col("doc_id").alias("file_id"), F.lit(1).alias("first"), F.lit(2).alias("first_col"), F.lit(4).alias("last"), F.lit(12).alias("last_col"))
    return pages.selection_text(lines(spark, sf), wanted, cap=500)


# context, pins, ranks

NEAR = f""", m AS (SELECT file_id, line_no FROM l WHERE {WORD_HIT}),
 c AS (SELECT DISTINCT l.file_id, l.line_no, l.text, EXISTS (SELECT 1 FROM m WHERE m.file_id = l.file_id AND m.line_no = l.line_no) AS is_match FROM l JOIN m ON m.file_id = l.file_id AND l.line_no BETWEEN m.line_no - 2 AND m.line_no + 1)"""


def _near(spark, sf):
    return context.context_in_table(docs(spark, sf), "doc_id", "text", WORD, before=2, after=1)


@query(f"{NEAR} SELECT file_id, line_no, text, is_match FROM c")
def context_lines(spark, sf):
    return keyed(_near(spark, sf), "text", "is_match")


GROUPS = """, g AS (SELECT *, coalesce(line_no <> lag(line_no) OVER w + 1, true) AS starts_group FROM c WINDOW w AS (PARTITION BY file_id ORDER BY line_no)),
 h AS (SELECT *, CAST(sum(CAST(starts_group AS INT)) OVER (PARTITION BY file_id ORDER BY line_no) - 1 AS BIGINT) AS group_no FROM g)"""


@query(f"{NEAR}{GROUPS} SELECT file_id, line_no, starts_group, group_no FROM h")
def context_groups(spark, sf):
    return keyed(context.context_groups(_near(spark, sf)), "starts_group", "group_no")


@query(f"{NEAR}{GROUPS} SELECT file_id, line_no, CASE WHEN starts_group AND group_no > 0 THEN '--' END AS separator, line_no || CASE WHEN is_match THEN ':' ELSE '-' END || text AS rendered FROM h")
def render_context(spark, sf):
    return render.render_context(_near(spark, sf))


@query(f" SELECT file_id, line_no, coalesce(line_no - lag(line_no) OVER (PARTITION BY file_id ORDER BY line_no) - 1, -1) AS gap FROM l WHERE {WORD_HIT}")
def match_gaps(spark, sf):
    return context.gaps(s.find(lines(spark, sf), WORD)).select("file_id", "line_no", F.coalesce("gap", F.lit(-1)).alias("gap"))


@query(f" SELECT file_id, line_no, line_no % 7 = 0 AS is_pinned FROM l WHERE {WORD_HIT}")
def pinned_results(spark, sf):
    return keyed(marks.mark_pinned(s.find(lines(spark, sf), WORD), pins(spark, sf)), "is_pinned")


@query(f" SELECT file_id, line_no, {WORD_HIT} AS is_match, line_no % 7 = 0 AS is_pinned FROM l WHERE {WORD_HIT} OR line_no % 7 = 0")
def union_pins(spark, sf):
    return marks.union_pins(s.find(lines(spark, sf), WORD), pins(spark, sf))


@query(f" SELECT file_id, count(*) AS total, count(*) FILTER (WHERE {WORD_HIT}) AS matches, count(*) FILTER (WHERE line_no % 7 = 0) AS pins, count(*) FILTER (WHERE {WORD_HIT} AND line_no % 7 = 0) AS both FROM l WHERE {WORD_HIT} OR line_no % 7 = 0 GROUP BY file_id")
def union_size(spark, sf):
    return marks.union_size(s.find(lines(spark, sf), WORD), pins(spark, sf))


@query(f" SELECT file_id, line_no FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_no) - 1 AS k FROM l WHERE {WORD_HIT} OR line_no % 7 = 0) WHERE k = 2")
def line_at(spark, sf):
    return keyed(marks.line_at(s.find(lines(spark, sf), WORD), pins(spark, sf), 2))


@query(f" SELECT file_id, line_no, CAST(coalesce(sum(CAST({WORD_HIT} AS INT)) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rank FROM l")
def rank_of_line(spark, sf):
    return ranks.rank_in_table(docs(spark, sf), "doc_id", "text", WORD)


TURNS = "t AS (SELECT conv_id AS file_id, turn AS line_no, text, regexp_matches(text, '(an|er|en) ') AS hit FROM conversations)"
TURN = Search("(an|er|en) ")


@query(" SELECT file_id, line_no, CAST(coalesce(sum(CAST(hit AS INT)) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rank FROM t", prefix=TURNS)
def rank_of_turn(spark, sf):
    return keyed(ranks.rank(s.flag_matches(turns(spark, sf), TURN), F.col("is_match")), "rank")


@query(" SELECT DISTINCT t.file_id, t.line_no, t.text, t.hit AS is_match FROM t JOIN t m ON m.hit AND m.file_id = t.file_id AND t.line_no BETWEEN m.line_no - 1 AND m.line_no + 2", prefix=TURNS)
def context_of_turns(spark, sf):
    every = turns(spark, sf)
    return keyed(context.with_context(every, s.find(every, TURN), before=1, after=2), "text", "is_match")


@query(f" SELECT file_id, line_no, text FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_no) - 1 AS k FROM l WHERE {WORD_HIT}) WHERE k = 3")
def select_kth(spark, sf):
    return keyed(ranks.select_k(s.find(lines(spark, sf), WORD), 3), "text")


@query(f" SELECT file_id, line_no FROM l WHERE {WORD_HIT} OR {HIT} OR line_no % 7 = 0")
def merge_batches(spark, sf):
    every = lines(spark, sf)
    return marks.merge_batches(s.find(every, WORD), s.find(every, NEEDLE), pins(spark, sf), pins(spark, sf))


@query(" SELECT file_id, line_no FROM l WHERE line_no % 7 = 0")
def restore_pins(spark, sf):
    return marks.restore_pins(pins(spark, sf), pins(spark, sf))


@query(" SELECT file_id, line_no FROM l WHERE line_no % 7 = 0 OR line_no % 5 = 0")
def restore_pins_of_sessions(spark, sf):
    """Two stored sets that share some lines."""
    return marks.restore_pins(pins(spark, sf), lines(spark, sf).where("line_no % 5 = 0").select("file_id", "line_no"))


@query(" SELECT file_id, line_no FROM l WHERE line_no % 7 = 0 AND NOT (file_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AND line_no BETWEEN 5 AND 15)")
def unpin_range(spark, sf):
    ranges = spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").select(F.col("doc_id").alias("file_id"), F.lit(5).cast("long").alias("first"), F.lit(15).cast("long").alias("last"))
    return marks.unpin(pins(spark, sf), ranges)


@query(
    """, r AS (SELECT DISTINCT doc_id AS file_id, CASE WHEN quality = 1 THEN 0 ELSE 1 END AS first FROM labels),
 p AS (SELECT file_id, line_no FROM l WHERE line_no % 7 = 0), x AS (SELECT file_id, unnest(range(first, first + 3)) AS line_no, first = 0 AND file_id IN (SELECT file_id FROM p) AS turned_on FROM r)
 SELECT file_id, line_no FROM p WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.file_id = p.file_id AND x.line_no = p.line_no AND x.turned_on)
 UNION SELECT file_id, line_no FROM x WHERE NOT turned_on"""
)
def toggle_pins(spark, sf):
    first = F.when(F.col("quality") == 1, 0).otherwise(1).cast("long")
    ranges = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("file_id"), first.alias("first"), (first + 2).alias("last")).distinct()
    return marks.toggle_pins(pins(spark, sf), ranges)


@query(f" SELECT file_id, line_no FROM l WHERE {WORD_HIT} AND line_no <> 4")
def drop_overlap(spark, sf):
    return keyed(marks.drop_overlap(s.find(lines(spark, sf), WORD), 4))


# spans and what is shown

# spans of runs of digits: sums over the pieces between them and the runs before them
SPANS = """, x AS (SELECT *, regexp_split_to_array(text, '[0-9]+') AS b, regexp_extract_all(text, '[0-9]+') AS f FROM l),
 y AS (SELECT *, list_transform(range(1, len(f) + 1), lambda k: {'start': CAST(coalesce(list_sum(list_transform(b[1:k], lambda t: UNIT(t))), 0) + coalesce(list_sum(list_transform(f[1:k - 1], lambda t: UNIT(t))), 0) AS INT), 'end': CAST(coalesce(list_sum(list_transform(b[1:k], lambda t: UNIT(t))), 0) + coalesce(list_sum(list_transform(f[1:k], lambda t: UNIT(t))), 0) AS INT)}) AS spans FROM x)"""
DIGITS = Search("[0-9]+")


@query(SPANS.replace("UNIT", "strlen") + " SELECT file_id, line_no, array_to_string(list_transform(spans, lambda s: s['start'] || '-' || s['end']), ',') AS spans FROM y")
def match_spans_bytes(spark, sf):
    return lines(spark, sf).select("file_id", "line_no", _shown(match_spans(F.col("text"), DIGITS)).alias("spans"))


@query(SPANS.replace("UNIT", "length") + " SELECT file_id, line_no, array_to_string(list_transform(spans, lambda s: s['start'] || '-' || s['end']), ',') AS spans FROM y")
def match_spans_chars(spark, sf):
    text = F.col("text")
    return lines(spark, sf).select("file_id", "line_no", _shown(byte_to_char_spans(text, match_spans(text, DIGITS))).alias("spans"))


def _shown(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")


@query(" SELECT file_id, line_no, regexp_replace(text, '[0-9]+', chr(27) || '[0;31m\\0' || chr(27) || '[0m', 'g') AS coloured FROM l")
def ansi_matches(spark, sf):
    return lines(spark, sf).select("file_id", "line_no", ansi(F.col("text"), DIGITS).alias("coloured"))


@query(f" SELECT file_id, line_no, line_no || ':' || text AS rendered FROM l WHERE {HIT}")
def render_lines(spark, sf):
    return render.render_lines(searched(spark, sf, NEEDLE))


@query(
    SPANS.replace("UNIT", "strlen").replace(" FROM l),", " FROM l WHERE regexp_matches(text, '[0-9]+')),")
    + """ SELECT file_id, line_no, '{"type":"match","path":"' || file_id || '","line_number":' || (line_no + 1) || ',"lines":{"text":' || CAST(to_json(text || chr(10)) AS VARCHAR) || '},"matches":[' || array_to_string(list_transform(spans, lambda s: '{"start":' || s['start'] || ',"end":' || s['end'] || '}'), ',') || ']}' AS json FROM y"""
)
def ndjson(spark, sf):
    return render.to_ndjson(s.find(lines(spark, sf), DIGITS), DIGITS)


@query(" SELECT file_id, line_no, file_id || ':' || (line_no + 1) AS ref FROM l")
def file_refs(spark, sf):
    return lines(spark, sf).select("file_id", "line_no", display.file_ref(F.concat(F.lit("/logs/"), F.col("file_id").cast("string")), F.col("line_no")).alias("ref"))


EXPAND = "list_reduce(string_split(t, chr(9)), lambda a, p: a || repeat(' ', CAST(8 - length(a) % 8 AS INT)) || p)"


@query(f", e AS (SELECT file_id, line_no, {TABBED} AS t FROM l) SELECT file_id, line_no, {EXPAND} AS shown FROM e")
def expanded_tabs(spark, sf):
    return tabbed(spark, sf).select("file_id", "line_no", display.display_line(F.col("text"), 8).alias("shown"))


@query(" SELECT file_id, line_no, CASE line_no % 3 WHEN 0 THEN text WHEN 1 THEN text || chr(13) ELSE chr(13) || text END AS shown FROM l")
def strip_carriage_returns(spark, sf):
    """Of one CR at the end, of two, and of one at the beginning, only the last at the end goes."""
    ends = F.when(F.col("line_no") % 3 == 0, F.concat("text", F.lit("\r"))).when(F.col("line_no") % 3 == 1, F.concat("text", F.lit("\r\r"))).otherwise(F.concat(F.lit("\r"), "text"))
    ended = lines(spark, sf).withColumn("text", ends)
    return ended.select("file_id", "line_no", display.strip_cr(F.col("text")).alias("shown"))


@query(
    f""", e AS (SELECT file_id, line_no, {TABBED} AS u FROM l), p AS (SELECT file_id, line_no, u, unnest(list_filter(range(1, length(u) + 1), lambda i: u[i] = chr(9))) AS pos FROM e WHERE contains(u, chr(9))),
 d AS (SELECT file_id, line_no, pos, unnest([left(u, pos - 1), left(u, pos)]) AS t FROM p), c AS (SELECT file_id, line_no, pos, min(length({EXPAND})) AS starts, max(length({EXPAND})) AS ends FROM d GROUP BY ALL)
 SELECT file_id, line_no, string_agg(starts || '-' || ends, ',' ORDER BY pos) AS spans FROM c GROUP BY file_id, line_no"""
)
def remapped_spans(spark, sf):
    """Where every tab of a line is shown."""
    text = F.col("text")
    tabs = match_spans(text, Search(r"\t"), "chars")
    rows = tabbed(spark, sf).where(F.contains(text, F.lit("\t")))
    return rows.select("file_id", "line_no", _shown(display.remap_spans(text, tabs, 8)).alias("spans"))


# what is shown in column c begins at a place of c at most, so the SQL looks no further
@query(
    f""", e AS (SELECT file_id, line_no, {TABBED} AS u FROM l), k AS (SELECT file_id, line_no, u, unnest(range(0, least(length(u), 150) + 1)) AS k FROM e), d AS (SELECT file_id, line_no, k, left(u, k) AS t FROM k), c AS (SELECT file_id, line_no, k, length({EXPAND}) AS col FROM d)
 SELECT file_id, line_no, CAST(max(k) FILTER (WHERE col <= 10) AS INT) AS first, CAST(max(k) FILTER (WHERE col <= 150) AS INT) AS last FROM c GROUP BY file_id, line_no"""
)
def display_to_raw(spark, sf):
    span = display.raw_range(F.col("text"), F.lit(10), F.lit(150), 8)
    return tabbed(spark, sf).select("file_id", "line_no", span["start"].alias("first"), span["end"].alias("last"))


PALETTE = [rules.Rule("license", 1, whole_line=True), rules.Rule("[0-9]+", 2, regex=True), rules.Rule("", 3, anchor_line=2, anchor_start=1, anchor_end=4)]


@query(
    SPANS.replace("UNIT", "length")
    + f""" SELECT file_id, line_no, array_to_string(list_concat(CASE WHEN {HIT} THEN [('0-' || length(text) || '-1-0')] ELSE [] END, list_transform(spans, lambda s: s['start'] || '-' || s['end'] || '-2-1'), CASE WHEN line_no = 2 THEN ['1-4-3-2'] ELSE [] END), ',') AS spans FROM y"""
)
def highlight_spans(spark, sf):
    one = lambda s: F.concat_ws("-", *[s[k].cast("string") for k in ("start", "end", "color", "priority")])
    return rules.highlight_spans(lines(spark, sf), PALETTE).select("file_id", "line_no", F.array_join(F.transform("spans", one), ",").alias("spans"))


@query(
    """, r AS (SELECT item_id AS priority, list_extract(string_split(text, ' '), 2) || ' ' || list_extract(string_split(text, ' '), 3) || ' ' || list_extract(string_split(text, ' '), 4) AS pattern FROM benchmark)
 SELECT DISTINCT file_id, line_no, priority, priority * 2 AS color FROM l JOIN r ON contains(l.text, r.pattern) WHERE trim(pattern) <> ''"""
)
def rules_on_lines(spark, sf):
    words = F.split("text", " ")
    table = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("priority"), F.concat_ws(" ", F.get(words, 1), F.get(words, 2), F.get(words, 3)).alias("pattern"), (F.col("item_id") * 2).alias("color"), F.lit(None).cast("bigint").alias("anchor_line"), F.lit(False).alias("ignore_case"))
    return rules.rules_on_lines(lines(spark, sf), table)


def _upper(text: Column) -> Column:
    """Upper case a character for a character, as the SQL has it: what would become several, such
    as ß, stays."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)), "")


FOLDED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    f""", r AS (SELECT item_id AS priority, upper(list_extract(string_split(text, ' '), 2)) AS word FROM benchmark)
 SELECT DISTINCT file_id, line_no, priority, priority AS color FROM l JOIN r ON CASE WHEN regexp_matches(word, '[^\\x{{00}}-\\x{{7F}}]') THEN contains(lower(l.text), lower(word)) WHEN priority % 2 = 0 OR regexp_matches(word, '[^A-Z]') THEN contains({FOLDED.format('l.text')}, {FOLDED.format('word')}) ELSE regexp_matches(l.text, '(?i)[0-9]+ ' || word) END"""
)
def rules_of_all_kinds(spark, sf):
    """Literals and regular expressions that ignore case, from one table of rules."""
    word = _upper(F.get(F.split("text", " "), 1))
    plain = (F.col("item_id") % 2 == 0) | word.rlike("[^A-Z]")
    table = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("priority"), F.when(plain, word).otherwise(F.concat(F.lit("[[:digit:]]+ "), word)).alias("pattern"), F.col("item_id").alias("color"), F.lit(None).cast("bigint").alias("anchor_line"), (~plain).alias("regex"))
    return rules.rules_on_lines(lines(spark, sf), table)


@query(" SELECT l.file_id, l.line_no, q.quality::BIGINT AS priority, 5::BIGINT AS color FROM l JOIN (SELECT DISTINCT quality FROM labels) q ON l.line_no = q.quality + 2")
def anchored_rules(spark, sf):
    quality = F.col("quality").cast("long")
    table = spark.read.parquet(f"{sf}/labels.parquet").select(quality.alias("priority"), F.lit("").alias("pattern"), F.lit(5).alias("color"), (quality + 2).alias("anchor_line")).distinct()
    return rules.rules_on_lines(lines(spark, sf), table)


@query(" SELECT CASE line_no WHEN 0 THEN substring(text, 4) WHEN 3 THEN left(text, 9) ELSE text END AS pattern, 7::BIGINT AS color, false AS whole_line, line_no AS anchor_line, CASE line_no WHEN 0 THEN 3 ELSE 0 END::INT AS anchor_start, CASE line_no WHEN 3 THEN least(9, length(text)) ELSE length(text) END::INT AS anchor_end FROM l WHERE file_id = (SELECT min(doc_id) FROM documents WHERE len(string_split(text, chr(10))) > 4) AND line_no <= 3 AND CASE line_no WHEN 0 THEN substring(text, 4) ELSE text END <> ''")
def rules_from_selection(spark, sf):
    every = docs(spark, sf)
    chosen = every.where(F.size(F.split("text", "\n", -1)) > 4).agg(F.min("doc_id")).first()[0]
    return rules.rules_from_selection(lines(spark, sf), chosen, 0, 3, 3, 9, 7)


@query(" SELECT item_id AS priority, text AS pattern FROM benchmark WHERE NOT (item_id % 9 BETWEEN 3 AND 5)", prefix="")
def remove_rules(spark, sf):
    table = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("priority"), F.col("text").alias("pattern"), (F.col("item_id") % 9).alias("anchor_line"))
    return rules.remove_rules(table, 3, 5).select("priority", "pattern")


@query(
    " SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'UTF-16 LE' WHEN doc_id % 3 = 1 THEN 'UTF-8' ELSE 'windows-1252' END AS encoding FROM documents",
    prefix="",
)
def encoding_names(spark, sf):
    raw = F.when(F.col("doc_id") % 3 == 0, "UTF-16LE").when(F.col("doc_id") % 3 == 1, "utf-8").otherwise("windows-1252")
    return docs(spark, sf).select("doc_id", encoding_name(raw).alias("encoding"))


# changes: an older snapshot of documents, of which some then grew, were rewritten, cut or removed


@query(
    """ SELECT doc_id AS file_id, CASE WHEN doc_id % 5 = 4 THEN 0 ELSE strlen(text) END AS old_size,
 CASE doc_id % 5 WHEN 1 THEN strlen(text) + 5 WHEN 2 THEN strlen(text) // 2 ELSE strlen(text) END AS new_size,
 CASE WHEN doc_id % 5 = 1 THEN 'DataAdded' WHEN doc_id % 5 = 4 AND strlen(text) > 0 THEN 'DataAdded' WHEN doc_id % 5 = 2 AND strlen(text) > 0 THEN 'Truncated' WHEN doc_id % 5 = 3 THEN 'Truncated' ELSE 'Unchanged' END AS change
 FROM documents WHERE text IS NOT NULL AND text <> ''""",
    prefix="",
)
def change_kinds(spark, sf):
    raw = docs(spark, sf).where("text <> ''").select(F.col("doc_id").alias("file_id"), F.col("text").cast("binary").alias("b"), (F.col("doc_id") % 5).alias("k"), F.octet_length("text").cast("long").alias("n"))
    size = F.when(F.col("k") == 1, F.col("n") + 5).when(F.col("k") == 2, F.floor(F.col("n") / 2)).otherwise(F.col("n")).cast("long")
    mark = lambda c: F.xxhash64(c)
    old = raw.where("k <> 4").select("file_id", F.col("n").alias("size"), mark("b").alias("head_hash"), mark("b").alias("tail_hash"))
    rewritten = F.when(F.col("k") == 3, F.concat(F.lit(b"\x01"), "b")).otherwise(F.col("b"))
    new = raw.select("file_id", size.alias("size"), mark(F.when(F.col("k") == 1, F.concat("b", F.lit(b"added"))).when(F.col("k") == 2, F.lit(b"x")).otherwise(rewritten)).alias("head_hash"), mark(rewritten).alias("tail_hash"), mark(rewritten).alias("prefix_hash"))
    return changes.change_kind(old, new)


# files and streams, written from documents to the shared folder first


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"


def _written(spark, sf) -> str:
    """documents' texts as text files, each text ended by LF."""
    folder = _folder(spark)
    docs(spark, sf).where("text IS NOT NULL").select(F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text")).alias("value")).write.option("lineSep", "\n").text(folder)
    return folder


WHOLE = """w AS (SELECT unnest(string_split('doc ' || doc_id || chr(10) || text, chr(10))) AS text FROM documents WHERE text IS NOT NULL)"""


@query(" SELECT text, count(*) AS n FROM w GROUP BY text", prefix=WHOLE)
def scanned_files(spark, sf):
    return files.read_lines(spark, _written(spark, sf), encoding="UTF-8", geometry=False).groupBy("text").agg(F.count("*").alias("n"))


@query(" SELECT count(*) AS line_count, CAST(sum(strlen(text) + 1) AS BIGINT) AS size, max(strlen(text)) AS max_line_len FROM w", prefix=WHOLE)
def scanned_geometry(spark, sf):
    rows = files.read_lines(spark, _written(spark, sf))
    # lines follow each other without gaps, whatever the files are
    info = rows.groupBy("file_id").agg(F.count("*").alias("n"), F.max(F.col("byte_start") + F.col("byte_len") + 1).alias("size"), F.max("byte_len").alias("longest"), (F.max("line_no") + 1).alias("last"))
    return info.where("n = last").agg(F.sum("n").alias("line_count"), F.sum("size").alias("size"), F.max("longest").alias("max_line_len"))


#: The encodings in which encoded_files writes, by doc_id modulo 6, and their marks.
WRITTEN = (("UTF-8", b""), ("UTF-8", b"\xef\xbb\xbf"), ("UTF-16LE", b"\xff\xfe"), ("UTF-16BE", b""), ("UTF-32LE", b"\xff\xfe\x00\x00"), ("windows-1252", b""))


def _stored(df: DataFrame, folder: str, form: Callable[..., tuple[str, bytes, bytes]]) -> None:
    """Write rows to files of a store, by the executors: form(*row) gives a file's name, what it
    begins with, and what the row adds to the task's file of that name."""

    def write(batches):
        name, opened = uuid.uuid4().hex, {}
        store, place, _ = store_of(folder)
        store.create_dir(place, recursive=True)
        for batch in batches:
            for row in batch.itertuples(index=False):
                kind, first, raw = form(*row)
                if kind not in opened:
                    opened[kind] = store.open_output_stream(f"{place}/{kind} {name}.log")
                    opened[kind].write(first)
                opened[kind].write(raw)
        for file in opened.values():
            file.close()
        yield pd.DataFrame({"n": pd.Series([], dtype="int64")})

    df.mapInPandas(write, "n long").count()


def _encoded(spark: SparkSession, sf: str, without: Column | None = None) -> str:
    """documents' texts as files of several encodings, some per task, whose names hold odd characters."""

    def form(doc_id, text, narrow):
        k = int(doc_id) % 6
        k = 0 if k == 5 and not narrow else k
        encoding, mark = WRITTEN[k]
        # the first line tells a legacy file from UTF-8
        return f"{encoding} {k} %20+#é", mark + "é first\n".encode(encoding), f"{text}\n".encode(encoding)

    folder = _folder(spark)
    narrow = ~F.col("text").rlike(r"[^\x00-\x7F\xA0-\xFF]")
    rows = docs(spark, sf).where("text IS NOT NULL")
    rows = rows if without is None else rows.where(~without)
    _stored(rows.select("doc_id", "text", narrow.alias("narrow")), folder, form)
    return folder


NARROW = "CASE WHEN doc_id % 6 = 5 AND regexp_matches(text, '[^\\x{00}-\\x{7F}\\x{A0}-\\x{FF}]') THEN 0 ELSE doc_id % 6 END"


@query(
    f" SELECT ['UTF-8', 'UTF-8', 'UTF-16LE', 'UTF-16BE', 'UTF-32LE', 'windows-1252'][k + 1] AS encoding, CASE k WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 4 THEN 4 ELSE 0 END AS bom_width, text, count(*) AS n FROM (SELECT {NARROW} AS k, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL) GROUP BY k, text",
    prefix="",
)
def encoded_files(spark, sf):
    """Every line of files in six forms, read back by their detected encodings."""
    folder = _encoded(spark, sf)
    found = files.detect_encodings(files.list_files(spark, folder)).select("file_id", "encoding", "bom_width")
    rows = files.read_lines(spark, folder, geometry=False).where("line_no > 0")
    # an encoding and a mark for each form
    return rows.groupBy("file_id", "text").agg(F.count("*").alias("n")).join(found, "file_id").groupBy("encoding", "bom_width", "text").agg(F.sum("n").alias("n"))


@query(
    f" SELECT k, CAST(sum(n) AS BIGINT) AS line_count, max(longest) AS max_line_len FROM (SELECT {NARROW} AS k, len(string_split(text, chr(10))) AS n, list_max(list_transform(string_split(text, chr(10)), lambda t: CASE {NARROW} WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 4 WHEN 5 THEN 1 ELSE 0 END * length(t) + CASE WHEN {NARROW} < 2 THEN strlen(t) ELSE 0 END)) AS longest FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[^\\x{{00}}-\\x{{FFFF}}]')) GROUP BY k",
    prefix="",
)
def file_reports(spark, sf):
    """Lines and longest line, in the files' own bytes, by form of file."""
    info = files.describe_files(spark, _encoded(spark, sf))
    form = F.regexp_extract("file_id", "([0-9]) %20", 1).cast("long")
    return info.groupBy(form.alias("k")).agg((F.sum("line_count") - F.count("*")).alias("line_count"), F.max("max_line_len").alias("max_line_len"))


@query(" SELECT encoding, text, count(*) AS n FROM (SELECT ['UTF-16LE', 'UTF-16BE'][doc_id % 2 + 1] AS encoding, unnest(string_split(replace(text, 'e', 'ਊĀਊ'), chr(10))) AS text FROM documents WHERE text IS NOT NULL) GROUP BY ALL", prefix="")
def straddled_feeds(spark, sf):
    """Characters of two bytes between which the bytes of an LF stand."""

    def form(doc_id, text):
        encoding, mark = (("UTF-16LE", b"\xff\xfe"), ("UTF-16BE", b"\xfe\xff"))[int(doc_id) % 2]
        return encoding, mark, (text.replace("e", "ਊĀਊ") + "\n").encode(encoding)

    folder = _folder(spark)
    _stored(docs(spark, sf).where("text IS NOT NULL").select("doc_id", "text"), folder, form)
    rows = files.read_lines(spark, folder)
    return rows.groupBy(F.regexp_extract("file_id", "(UTF-16.E)[^/]*$", 1).alias("encoding"), "text").agg(F.count("*").alias("n"))


@query(" SELECT text, count(*) AS n FROM (SELECT unnest(string_split(replace(replace(text, 'e ', chr(65533) || chr(65533) || ' '), 'the', 'th' || chr(65533)), chr(10))) AS text FROM documents WHERE text IS NOT NULL) GROUP BY text", prefix="")
def invalid_bytes(spark, sf):
    """Bytes that no character begins with, and beginnings of characters that don't go on; the
    folder is named twice, and as a pattern, and read once."""

    def form(text):
        return "raw", b"", (text.replace("e ", "\x00 ").replace("the", "th\x01") + "\n").encode().replace(b"\x00", b"\xff\xc3").replace(b"\x01", b"\xe2\x82")

    folder = _folder(spark)
    _stored(docs(spark, sf).where("text IS NOT NULL").select("text"), folder, form)
    return files.read_lines(spark, [folder, folder, f"{folder}/*"], encoding="UTF-8").groupBy("text").agg(F.count("*").alias("n"))


def _altered(spark: SparkSession, found: DataFrame, step: int = 1 << 20) -> None:
    """Write each file anew, by the digit that begins its name: 0 as it was, 1 longer, 2 cut in
    half, 3 its first byte another, 4 its middle byte another, 5 its first byte another and longer."""

    def write(batches):
        for batch in batches:
            for path in batch["file_id"]:
                store, inner, _ = store_of(path)
                k = int(inner.rpartition("/")[2][0])
                with open_file(path) as old, store.open_output_stream(f"{inner}.new") as new:
                    size = old.size()
                    spot = {3: 0, 4: size // 2, 5: 0}.get(k)
                    stop = size // 2 if k == 2 else size
                    for at in range(0, stop, step):
                        raw = bytearray(old.read_at(min(step, stop - at), at))
                        if spot is not None and at <= spot < at + len(raw):
                            raw[spot - at] ^= 1
                        new.write(bytes(raw))
                    new.write(b"more\n" if k in (1, 5) else b"")
                store.move(f"{inner}.new", inner)
        yield pd.DataFrame({"n": pd.Series([], dtype="int64")})

    found.select("file_id").mapInPandas(write, "n long").count()


@query(
    """ SELECT doc_id % 6 AS kind, ['Unchanged', 'DataAdded', 'Truncated', 'Truncated', 'Unchanged', 'Truncated'][doc_id % 6 + 1] AS change, 'UTF-8' AS encoding, 0 AS bom_width, CAST(sum(len(string_split(text, chr(10))) + 1) AS BIGINT) AS line_count FROM documents WHERE text IS NOT NULL GROUP BY ALL""",
    prefix="",
)
def file_states(spark, sf):
    """Snapshots before and after files were written anew; what changes beyond the bytes that are
    hashed, at the same size, isn't seen."""
    folder = _folder(spark)
    _stored(docs(spark, sf).where("text IS NOT NULL").select("doc_id", "text"), folder, lambda doc_id, text: (f"{doc_id % 6}", b"", f"a line that begins the document\n{text}\n".encode()))
    found = files.list_files(spark, folder)
    state, info = cut(files.file_states(found, window=16)), cut(files.describe_files(spark, folder))
    _altered(spark, found)
    change = changes.change_kind(state, files.file_states(files.list_files(spark, folder), window=16, old=state))
    kind = F.regexp_extract("file_id", "([0-9]) [^/]*$", 1).cast("long")
    return change.join(info, "file_id").groupBy(kind.alias("kind"), "change", "encoding", "bom_width").agg(F.sum("line_count").alias("line_count"))


@query(
    f""" SELECT k AS file_id, '{{"path":"' || k || '","size":' || CAST(sum(size) AS BIGINT) || ',"line_count":' || CAST(sum(n) AS BIGINT) || ',"max_line_len":' || max(longest) || ',"encoding":"' || ['UTF-8', 'UTF-8', 'UTF-16 LE', 'UTF-16 BE', 'UTF-32LE', 'windows-1252'][k + 1] || '"}}' AS json FROM (SELECT k, len(ls) AS n, list_max(list_transform(ls, lambda t: u * length(t) + CASE WHEN k < 2 THEN strlen(t) ELSE 0 END)) AS longest, u * (length(text) + 1) + CASE WHEN k < 2 THEN strlen(text) + 1 ELSE 0 END AS size
 FROM (SELECT *, {NARROW} AS k, string_split(text, chr(10)) AS ls, CASE {NARROW} WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 4 WHEN 5 THEN 1 ELSE 0 END AS u FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[^\\x{{00}}-\\x{{FFFF}}]'))) GROUP BY k""".replace("UTF-32LE", "UTF-32 LE"),
    prefix="",
)
def info_json_encoding(spark, sf):
    """Facts with the detected encoding's name, of all files of a form together: without their
    first lines and marks."""
    info = files.describe_files(spark, _encoded(spark, sf, F.col("text").rlike(r"[^\x{0}-\x{FFFF}]")))
    first = F.when(F.col("encoding") == "UTF-8", 9).when(F.col("encoding").startswith("UTF-16"), 16).when(F.col("encoding").startswith("UTF-32"), 32).otherwise(8)
    form = F.regexp_extract("file_id", "([0-9]) %20", 1).cast("long").alias("file_id")
    every = info.groupBy(form).agg(F.sum(F.col("size") - F.col("bom_width") - first).alias("size"), F.sum(F.col("line_count") - 1).alias("line_count"), F.max("max_line_len").alias("max_line_len"), F.first(encoding_name(F.col("encoding"))).alias("encoding"))
    return render.info_json(every, ("encoding",))


def _streamed(spark, stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream has to give now, through Parquet in the shared folder."""
    folder = _folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("append").parquet(f"{folder}/out")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query(f" SELECT text, count(*) AS n FROM w WHERE {HIT} GROUP BY text", prefix=WHOLE)
def follow_search_new_files(spark, sf):
    stream = follow.follow_search(follow.follow_new_files(spark, _written(spark, sf)), NEEDLE)
    return _streamed(spark, stream).groupBy("text").agg(F.count("*").alias("n"))


@query(f" SELECT CAST(sum(CAST({HIT} AS INT)) AS BIGINT) AS matches, count(*) AS processed_lines FROM w", prefix=WHOLE)
def follow_running_counts(spark, sf):
    stream = follow.running_counts(follow.follow_new_files(spark, _written(spark, sf)), NEEDLE)
    return _streamed(spark, stream, "complete").agg(F.sum("matches").alias("matches"), F.sum("processed_lines").alias("processed_lines"))


# growing files: written whole by the executors, then copied in steps to a folder that is followed

#: Shares of the documents, each of so many bytes of their table at least, and how many shares' files are on disk at a time.
SHARES, SHARE_BYTES, AT_ONCE = 12, 32 << 20, 3
#: Whether shuffled files go when what they were made for has ended, not when the driver happens to collect garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _in_shares(spark: SparkSession, sf: str, work: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows of work(texts, folder) for each share of the documents: together they are all
    documents. Of many shares some run side by side, as a stream's batches wait more than they
    work; of few, one after another. Rows are kept as Parquet; the files that a share was written
    to and followed in are removed when it ends."""
    every = docs(spark, sf).where("text IS NOT NULL")
    size = int(str(docs(spark, sf)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n, parts = max(1, min(SHARES, size // SHARE_BYTES)), every.rdd.getNumPartitions()
    tasks = max(-(-parts // n), min(parts, spark.sparkContext.defaultParallelism))
    kept, cleaned = _folder(spark), spark.conf.get(CLEANED)

    def share(k: int) -> str | None:
        texts = every if n == 1 else every.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) == k)
        if n > 1 and texts.isEmpty():
            return None
        folder = _folder(spark)
        work(texts.select("text").coalesce(tasks), folder).write.option("compression", "zstd").parquet(f"{kept}/{k}")
        _removed(folder)
        return f"{kept}/{k}"

    ensure_callback_server_started(spark.sparkContext._gateway)
    spark.conf.set(CLEANED, "true")
    try:
        with ThreadPoolExecutor(max(1, n * AT_ONCE // SHARES)) as pool:
            done = [path for path in pool.map(share, range(n)) if path]
    finally:
        spark.conf.set(CLEANED, cleaned)
    return spark.read.parquet(*done)


def _removed(folder: str) -> None:
    store, place, _ = store_of(folder)
    store.delete_dir(place)


def _whole(texts: DataFrame, folder: str, encoding: str = "UTF-8", first: bytes = b"", mark: str = "") -> str:
    """Documents' texts, a file for each task; `mark` comes before each line."""

    def form(text):
        return "task", first, "".join(f"{mark}{line}\n" for line in text.split("\n")).encode(encoding)

    _stored(texts, folder, form)
    return folder


def _grown(spark: SparkSession, whole: str, folder: str, part: float, step: int = 1 << 20) -> None:
    """The first `part` of the bytes of each whole file, in files numbered by their names' order."""
    names = [n for n, _, _ in listed(whole)]

    def copy(batches):
        store, place, _ = store_of(folder)
        store.create_dir(place, recursive=True)
        for batch in batches:
            for k, name in zip(batch["k"], batch["name"], strict=True):
                with open_file(name) as source, store.open_output_stream(f"{place}/{k:05}.log") as file:
                    size = int(source.size() * part)
                    for at in range(0, size, step):
                        file.write(source.read_at(min(step, size - at), at))
        yield pd.DataFrame({"n": pd.Series([], dtype="int64")})

    rows = spark.createDataFrame(list(enumerate(names)), "k int, name string")
    rows.repartition(max(len(names), 1)).mapInPandas(copy, "n long").count()


def _followed(spark: SparkSession, folder: str, twice: bool = False, **options) -> None:
    """What has come to the folder since the last time, numbered, appended to out beside it;
    `twice` brings a fifth of the rows a second time, and once each is kept."""
    number, once = follow.Numbering(f"{folder}-numbers"), follow.OnceEach(f"{folder}-once")

    def keep(batch: DataFrame, k: int) -> None:
        rows = number(batch, k)
        if twice:
            rows = once(rows.unionByName(rows.where("line_no % 5 = 0")), k)
        rows.write.mode("append").parquet(f"{folder}-out")

    stream = follow.follow_lines(spark, folder, state=f"{folder}-offsets", **options)
    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}-checkpoint").foreachBatch(keep)
    if "max_bytes" not in options:
        query.trigger(availableNow=True).start().awaitTermination()
        return
    # several batches of the limit's size
    running = query.start()
    running.processAllAvailable()
    running.stop()


def _agreeing(spark: SparkSession, folder: str, encoding: str) -> DataFrame:
    """Followed lines that agree in file, number, text and place with a reading of the whole files."""
    name = F.element_at(F.split("file_id", "/"), -1).alias("file")
    whole = files.read_lines(spark, folder, encoding=encoding, geometry=True).select(name, "line_no", "text", "byte_start")
    followed = spark.read.parquet(f"{folder}-out").where("generation = 0").select(name, "line_no", "text", "byte_start")
    return followed.join(whole, ["file", "line_no", "text", "byte_start"]).select("text")


SPLIT = "w AS (SELECT unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL)"


@query(" SELECT text, count(*) AS n FROM w GROUP BY text", prefix=SPLIT)
def follow_growing_files(spark, sf):
    """Files cut within a line, followed in limited batches, completed, followed again."""

    def work(texts, folder):
        whole, place = _whole(texts, f"{folder}/whole"), f"{folder}/in"
        for part in (0.37, 0.8, 1.0):
            _grown(spark, whole, place, part)
            _followed(spark, place, max_bytes=1 << 22)
        _removed(whole)
        return _agreeing(spark, place, "UTF-8")

    return _in_shares(spark, sf, work).groupBy("text").agg(F.count("*").alias("n"))


@query(" SELECT text, count(*) AS n FROM (SELECT text FROM w UNION ALL SELECT 'first line') GROUP BY text HAVING text <> 'first line'", prefix=SPLIT)
def follow_wide_files(spark, sf):
    """UTF-16LE files with a mark, whose growths end within lines and characters."""

    def work(texts, folder):
        whole, place = _whole(texts, f"{folder}/whole", "utf-16-le", "\ufefffirst line\n".encode("utf-16-le")), f"{folder}/in"
        for part in (0.31, 0.7777, 1.0):
            _grown(spark, whole, place, part)
            _followed(spark, place)
        _removed(whole)
        return _agreeing(spark, place, "UTF-16LE").where("text <> 'first line'")

    return _in_shares(spark, sf, work).groupBy("text").agg(F.count("*").alias("n"))


@query(" SELECT generation, text, count(*) AS n FROM (SELECT 0 AS generation, text FROM w UNION ALL SELECT 1, 'again ' || text FROM w) GROUP BY ALL", prefix=SPLIT)
def follow_rewritten_files(spark, sf):
    """Files that are followed, then replaced: the new ones' lines come from their beginnings as
    another generation, numbered from 0, and each once though some are read again."""

    def work(texts, folder):
        place = f"{folder}/in"
        for k, mark in enumerate(("", "again ")):
            whole = _whole(texts, f"{folder}/whole {k}", mark=mark)
            _grown(spark, whole, place, 1.0)
            _removed(whole)
            _followed(spark, place, twice=True)
        rows = spark.read.parquet(f"{place}-out")
        # numbers without a gap, from 0, in each of a file's two lives
        gapless = rows.groupBy("file_id", "generation").agg((F.max("line_no") + 1 == F.count_distinct("line_no")).alias("gapless"))
        return rows.join(gapless.where("gapless"), ["file_id", "generation"]).select("generation", "text")

    return _in_shares(spark, sf, work).groupBy("generation", "text").agg(F.count("*").alias("n"))
