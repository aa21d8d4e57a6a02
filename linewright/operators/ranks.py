"""Numbers by line order within a file, in two levels.

A file's lines are grouped into ranges of line numbers. What a range holds is summed first;
running sums over the ranges (few rows) and within each range give the rest. So one huge
file is spread over as many tasks as it has ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linewright.functions.predicates import Search, in_range, matches
from linewright.sources.tables import hits_from_table

#: Lines of a range.
RANGE_LINES = 1 << 16
#: Below this a file's first rows are found by a limit in each task before the shuffle.
FEW = 1000


def ranged(lines: DataFrame, range_lines: int = RANGE_LINES) -> DataFrame:
    """Adds _range, the range of a line's number."""
    return lines.withColumn("_range", F.floor(F.col("line_no") / range_lines).cast("long"))


def over_ranges(spans: DataFrame, first: Column, last: Column, range_lines: int = RANGE_LINES) -> DataFrame:
    """A row for each range that holds a line of [first, last], with _range: what joins on file
    and range spreads one huge file over its ranges."""
    at = lambda c: F.floor(c / range_lines).cast("long")
    return spans.withColumn("_range", F.explode(F.when(last >= first, F.sequence(at(first), at(last))).otherwise(F.array().cast("array<bigint>"))))


def running(lines: DataFrame, value: Column, name: str, range_lines: int = RANGE_LINES, total: str | None = None) -> DataFrame:
    """Adds `name`: the sum of `value` over the file's lines strictly before each line, and
    with `total` a column of that name: the sum over all the file's lines.

    Lines are joined to the sums of the ranges before theirs, which only files of several
    ranges have; the join keeps the order that the window within a range has made.
    """
    rows = ranged(lines, range_lines).withColumn("_value", value)
    sums = rows.groupBy("file_id", "_range").agg(F.sum("_value").alias("_sum"))
    file = Window.partitionBy("file_id")
    earlier = F.sum("_sum").over(file.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    base = sums.select("file_id", "_range", F.coalesce(earlier, F.lit(0)).alias("_earlier"), *([F.sum("_sum").over(file).alias(total)] if total else []))
    inside = Window.partitionBy("file_id", "_range").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(name, F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    joined = rows.join(base, ["file_id", "_range"]) if total else rows.join(base.where("_earlier <> 0"), ["file_id", "_range"], "left")
    return joined.withColumn(name, F.col(name) + F.coalesce("_earlier", F.lit(0))).drop("_range", "_value", "_earlier")


def rank(lines: DataFrame, hit: Column) -> DataFrame:
    """Adds rank: how many lines of the file match strictly before each line."""
    return running(lines, F.when(hit, 1).otherwise(0), "rank")


def rank_in_table(table: DataFrame, id_col: str, text_col: str, search: Search) -> DataFrame:
    """(file_id, line_no, rank) of a table's texts, without a shuffle: lines from one match to the
    next, that one included, have the same number of matches before them."""
    search.checked(table.sparkSession)
    whole = hits_from_table(table, id_col, text_col, lambda line, k: matches(line, search) & in_range(k, search.start, search.end))
    # a last stretch ends with the text
    ends = whole.select("file_id", F.concat("_hits", F.array(F.col("_n") - 1)).alias("_ends"))
    begins = ends.select("file_id", "_ends", F.concat(F.array(F.lit(0)), F.transform("_ends", lambda k: k + 1)).alias("_begins"))
    stretches = begins.select("file_id", F.posexplode(F.arrays_zip("_begins", "_ends")).alias("rank", "_s")).where("_s._begins <= _s._ends")
    return stretches.select("file_id", F.explode(F.sequence(F.col("_s._begins").cast("long"), F.col("_s._ends").cast("long"))).alias("line_no"), F.col("rank").cast("long").alias("rank"))


def numbered(lines: DataFrame) -> DataFrame:
    """Adds place: each row's place in its file's line order, from 0."""
    return running(lines, F.lit(1), "place")


def select_k(matches: DataFrame, k: int) -> DataFrame:
    """Each file's k-th match, from 0; a file of fewer has none. For a small k each task hands
    on no more than its first k + 1 matches of a file."""
    if k < FEW:
        place = F.row_number().over(Window.partitionBy("file_id").orderBy("line_no"))
        return matches.withColumn("_k", place).where(F.col("_k") == k + 1).drop("_k")
    return numbered(matches).where(F.col("place") == k).drop("place")


def stride_sample(matches: DataFrame, most: int) -> DataFrame:
    """About `most` matches of each file, evenly spread: every step-th, step being the whole
    quotient of their number and `most`, 1 at least; the first is always there."""
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / most))
    return running(matches, F.lit(1), "_place", total="_n").where(F.col("_place") % step == 0).drop("_place", "_n")
