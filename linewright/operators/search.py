"""Search over lines, and what is counted, taken and fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linewright.functions.predicates import Search, in_range, matches, may_match
from linewright.operators.ranks import FEW, over_ranges, ranged
from linewright.sources.tables import lines_from_table


def _hit(lines: DataFrame, search: Search):
    search.checked(lines.sparkSession)
    return matches(F.col("text"), search) & in_range(F.col("line_no"), search.start, search.end)


def flag_matches(lines: DataFrame, search: Search) -> DataFrame:
    """All lines, with is_match."""
    return lines.withColumn("is_match", _hit(lines, search))


def find(lines: DataFrame, search: Search) -> DataFrame:
    """The matching lines, in no order; with a limit, the first by file and line."""
    found = lines.where(_hit(lines, search))
    return found if search.limit is None else first_n(found, search.limit)


def find_in_table(table: DataFrame, id_col: str, text_col: str, search: Search) -> DataFrame:
    """The matching lines of a table's texts.

    What a line holds is in its whole text too, so that only the texts that hold a literal, or
    what every match of an expression needs, are split into lines at all.
    """
    text = F.col(text_col)
    if not search.regex:
        table = table if any("\n" in p for p in search.patterns) else table.where(matches(text, search))
    elif (able := may_match(text, search)) is not None:
        table = table.where(able)
    return find(lines_from_table(table, id_col, text_col), search)


def ordered(found: DataFrame) -> DataFrame:
    """By file and line number."""
    return found.orderBy("file_id", "line_no")


def first_n(found: DataFrame, n: int) -> DataFrame:
    """The first n by file and line."""
    return found.orderBy("file_id", "line_no").limit(n)


def first_n_of_each(found: DataFrame, n: int) -> DataFrame:
    """Each file's first n by line; rows beyond the n-th are dropped before the shuffle."""
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("line_no"))
    return found.withColumn("_k", place).where(F.col("_k") <= n).drop("_k")


def count_matches(lines: DataFrame, search: Search) -> DataFrame:
    """Per file: matches (matching lines, however often) and processed_lines."""
    inside = in_range(F.col("line_no"), search.start, search.end)
    return lines.groupBy("file_id").agg(F.count_if(_hit(lines, search)).alias("matches"), F.count_if(inside).alias("processed_lines"))


def search_status(lines: DataFrame, search: Search) -> DataFrame:
    """One row: matches_found, processed_lines, total_lines, done."""
    inside = in_range(F.col("line_no"), search.start, search.end)
    return lines.agg(F.count_if(_hit(lines, search)).alias("matches_found"), F.count_if(inside).alias("processed_lines"), F.count("*").alias("total_lines")).withColumn("done", F.lit(True))


def find_with_progress(lines: DataFrame, search: Search, name: str = "search") -> tuple[DataFrame, Observation]:
    """find() without a limit, and what search_status() counts, gathered by the same pass: once an
    action on the matches has ended, the observation's `get` has matches_found, processed_lines and
    total_lines; on a stream each batch reports them to a StreamingQueryListener."""
    progress = Observation(name)
    inside = in_range(F.col("line_no"), search.start, search.end)
    flagged = lines.withColumn("_hit", _hit(lines, search))
    counted = flagged.observe(progress, F.count_if("_hit").alias("matches_found"), F.count_if(inside).alias("processed_lines"), F.count(F.lit(1)).alias("total_lines"))
    return counted.where("_hit").drop("_hit"), progress


def exists(lines: DataFrame, search: Search) -> bool:
    """Whether any line matches; the first match ends the work."""
    return not lines.where(_hit(lines, search)).select("line_no").limit(1).isEmpty()


def exists_by_file(lines: DataFrame, search: Search) -> DataFrame:
    """Per file: whether any line matches."""
    return lines.groupBy("file_id").agg(F.bool_or(_hit(lines, search)).alias("found"))


def file_info(lines: DataFrame) -> DataFrame:
    """Per file with lines: line_count, max_line_len (bytes, CR included), size (of lines and LFs)."""
    size = F.sum(F.col("byte_len") + F.col("has_lf").cast("int"))
    return lines.groupBy("file_id").agg(F.count("*").alias("line_count"), F.max("byte_len").alias("max_line_len"), size.alias("size"))


def tail(lines: DataFrame, n: int = 10) -> DataFrame:
    """Each file's last n lines.

    For a small n each task hands on no more than its last n lines of a file, so that one
    huge file's text isn't shuffled; a larger n needs each file's last number first.
    """
    if n < FEW:
        place = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("line_no")))
        return lines.withColumn("_k", place).where(F.col("_k") <= n).drop("_k")
    counts = lines.groupBy("file_id").agg(F.max("line_no").alias("_last"))
    ends = over_ranges(counts, F.greatest(F.col("_last") - n + 1, F.lit(0).cast("long")), F.col("_last"))
    return ranged(lines).join(ends, ["file_id", "_range"]).where(F.col("line_no") > F.col("_last") - n).drop("_last", "_range")


def read_range(lines: DataFrame, start: int, count: int) -> DataFrame:
    """Lines [start, start + count) of each file, as far as there are any."""
    return lines.where(in_range(F.col("line_no"), max(start, 0), start + count))


def go_to_line(lines: DataFrame, number: int, clamp: bool = False) -> DataFrame:
    """Each file's line of a number counted from 1: none if out of range, or with `clamp` the
    nearest there is."""
    if not clamp:
        return lines.where(F.col("line_no") == number - 1)
    # the nearest is the last of the lines up to it
    return tail(lines.where(F.col("line_no") <= max(number - 1, 0)), 1)


def fetch(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """The lines whose (file_id, line_no) are wanted, each once."""
    return lines.join(wanted.select("file_id", "line_no"), ["file_id", "line_no"], "left_semi")


def next_page(found: DataFrame, after: tuple | None, size: int = 100) -> DataFrame:
    """The next `size` rows by file and line after a place; None begins. No page costs more
    for lying far in."""
    if after is not None:
        file_id, line_no = after
        found = found.where((F.col("file_id") > file_id) | ((F.col("file_id") == file_id) & (F.col("line_no") > line_no)))
    return first_n(found, size)


def history(log: DataFrame, pattern: str, time: str, most: int = 20) -> DataFrame:
    """Distinct patterns, the latest used first, at most `most`."""
    return log.where(F.trim(pattern) != "").groupBy(F.col(pattern).alias("pattern")).agg(F.max(time).alias("last_used")).orderBy(F.desc("last_used"), "pattern").limit(most)


def forget(log: DataFrame, pattern: str, gone: list[str] | None = None) -> DataFrame:
    """The log without some patterns, or emptied."""
    return log.limit(0) if gone is None else log.where(~F.col(pattern).isin(gone))
