"""Lines around matches, and the groups that they form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linewright.checkpoints import cut
from linewright.functions.predicates import Search, in_range, matches
from linewright.operators.ranks import RANGE_LINES, ranged
from linewright.sources.tables import hits_from_table, line_columns

#: Wanted lines, or ranges of this many lines that hold one, are broadcast up to a number of rows.
BROADCAST_ROWS, BLOCK_LINES = 500_000, 256


def with_context(lines: DataFrame, found: DataFrame, before: int = 0, after: int = 0, around: int = 0) -> DataFrame:
    """Matches and up to `before` lines before and `after` after each, once, with is_match.

    `around` stands for whichever of the two is 0. Only the matches are spread out, not the
    lines; numbers beyond a file's end find no line. The wanted numbers are counted, and
    broadcast if they are few; else the ranges of BLOCK_LINES lines that hold one choose the lines
    before these are shuffled, by broadcast too if the ranges are few. Lines of a table's texts
    need none of it: see context_in_table.
    """
    before, after = before or around, after or around
    near = F.explode(F.sequence(F.greatest(F.col("line_no") - before, F.lit(0)), F.col("line_no") + after))
    spread = found.select("file_id", F.col("line_no").alias("_hit"), near.alias("line_no"))
    wanted = cut(spread.groupBy("file_id", "line_no").agg(F.bool_or(F.col("_hit") == F.col("line_no")).alias("is_match")))
    if wanted.count() <= BROADCAST_ROWS:
        return lines.join(F.broadcast(wanted), ["file_id", "line_no"])
    block = F.floor(F.col("line_no") / BLOCK_LINES).alias("_block")
    blocks = cut(wanted.select("file_id", block).distinct())
    if blocks.count() <= BROADCAST_ROWS:
        lines = lines.withColumn("_block", block).join(F.broadcast(blocks), ["file_id", "_block"], "left_semi").drop("_block")
    return lines.join(wanted, ["file_id", "line_no"])


def context_in_table(table: DataFrame, id_col: str, text_col: str, search: Search, before: int = 0, after: int = 0, around: int = 0) -> DataFrame:
    """with_context() of a table's texts: (file_id, line_no, text, byte_len, has_lf, is_match).

    The wanted lines of a text are found among its lines before these part, so that nothing is
    shuffled, and no other line is ever a row.
    """
    before, after = before or around, after or around
    search.checked(table.sparkSession)
    whole = hits_from_table(table, id_col, text_col, lambda line, k: matches(line, search) & in_range(k, search.start, search.end)).where(F.size("_hits") > 0)
    near = F.flatten(F.transform("_hits", lambda k: F.sequence(F.greatest(k - before, F.lit(0)), F.least(k + after, F.col("_n") - 1))))
    parted = whole.select("file_id", "_lf", "_n", "_lines", "_hits", F.explode(F.array_distinct(near)).alias("line_no"))
    rows = parted.withColumn("_text", F.get("_lines", F.col("line_no"))).withColumn("is_match", F.array_contains("_hits", F.col("line_no")))
    return rows.select("file_id", *line_columns("_text"), "is_match")


def context_groups(rows: DataFrame, range_lines: int = RANGE_LINES) -> DataFrame:
    """Adds starts_group (the line before isn't there) and group_no (from 0 in each file).

    Both are told within ranges of line numbers, as if a range's first row began a group; what
    the ranges before hold, a row for each, puts that right.
    """
    inside = Window.partitionBy("file_id", "_range").orderBy("line_no")
    gone = F.col("line_no") - F.lag("line_no").over(inside) - 1
    marked = ranged(rows, range_lines).withColumn("starts_group", F.coalesce(gone > 0, F.lit(True)))
    ends = marked.groupBy("file_id", "_range").agg(F.min("line_no").alias("_first"), F.max("line_no").alias("_last"), F.count_if("starts_group").alias("_n"))
    file = Window.partitionBy("file_id").orderBy("_range")
    goes_on = F.coalesce(F.lag("_last").over(file) == F.col("_first") - 1, F.lit(False))
    ends = ends.select("file_id", "_range", "_first", goes_on.alias("_goes_on"), (F.col("_n") - goes_on.cast("long")).alias("_n"))
    before = F.coalesce(F.sum("_n").over(file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = ends.select("file_id", "_range", "_first", "_goes_on", before.alias("_before")).where("_before <> 0")
    counted = marked.withColumn("group_no", F.count_if("starts_group").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    joined = counted.join(base, ["file_id", "_range"], "left")
    goes_on = F.coalesce("_goes_on", F.lit(False))
    number = F.col("group_no") + F.coalesce("_before", F.lit(0)) - goes_on.cast("long")
    starts = F.col("starts_group") & ~(goes_on & (F.col("line_no") == F.col("_first")))
    return joined.withColumn("group_no", number).withColumn("starts_group", F.coalesce(starts, F.col("starts_group"))).drop("_range", "_first", "_goes_on", "_before")


def gaps(rows: DataFrame, range_lines: int = RANGE_LINES) -> DataFrame:
    """Adds gap: how many lines are missing since the row before in the file (null at the
    first). The row before a range's first is the last of the ranges before."""
    marked = ranged(rows, range_lines).withColumn("_back", F.lag("line_no").over(Window.partitionBy("file_id", "_range").orderBy("line_no")))
    last = F.lag("_last").over(Window.partitionBy("file_id").orderBy("_range"))
    base = marked.groupBy("file_id", "_range").agg(F.max("line_no").alias("_last")).withColumn("_last", last).where("_last IS NOT NULL")
    joined = marked.join(base, ["file_id", "_range"], "left")
    return joined.withColumn("gap", F.col("line_no") - F.coalesce("_back", "_last") - 1).drop("_range", "_back", "_last")
