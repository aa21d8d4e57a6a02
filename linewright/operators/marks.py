"""Pinned lines together with matches: unions, toggles, overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.operators.ranks import RANGE_LINES, numbered, over_ranges, ranged

KEYS = ["file_id", "line_no"]
#: The most lines of a range that is pinned at once.
MOST_PINS = 10_001


def union_pins(found: DataFrame, pins: DataFrame) -> DataFrame:
    """(file_id, line_no, is_match, is_pinned): matches and pins, each line once."""
    both = found.select(*KEYS, F.lit(True).alias("m"), F.lit(False).alias("p")).union(pins.select(*KEYS, F.lit(False), F.lit(True)))
    return both.groupBy(*KEYS).agg(F.bool_or("m").alias("is_match"), F.bool_or("p").alias("is_pinned"))


def union_size(found: DataFrame, pins: DataFrame) -> DataFrame:
    """Per file: total, matches, pins and both (lines that are both count once in total)."""
    both = F.col("is_match") & F.col("is_pinned")
    return union_pins(found, pins).groupBy("file_id").agg(F.count("*").alias("total"), F.count_if("is_match").alias("matches"), F.count_if("is_pinned").alias("pins"), F.count_if(both).alias("both"))


def line_at(found: DataFrame, pins: DataFrame, index: int) -> DataFrame:
    """Each file's line at a place, from 0, of matches and pins in line order."""
    return numbered(union_pins(found, pins)).where(F.col("place") == index).drop("place")


def mark_pinned(rows: DataFrame, pins: DataFrame) -> DataFrame:
    """Adds is_pinned."""
    marks = pins.select(*KEYS).distinct().withColumn("is_pinned", F.lit(True))
    return rows.join(marks, KEYS, "left").withColumn("is_pinned", F.coalesce("is_pinned", F.lit(False)))


def merge_batches(*batches: DataFrame) -> DataFrame:
    """Match batches in any order of arrival, each line once."""
    out = batches[0].select(*KEYS)
    for batch in batches[1:]:
        out = out.union(batch.select(*KEYS))
    return out.distinct()


def restore_pins(*stored: DataFrame) -> DataFrame:
    """Pins without repeats."""
    return merge_batches(*stored)


def unpin(pins: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pins that no range (file_id, first, last) covers."""
    covered = ranges.select("file_id", F.explode(F.sequence("first", "last")).alias("line_no")).distinct()
    return pins.join(covered, KEYS, "left_anti")


def toggle_pins(pins: DataFrame, ranges: DataFrame, most: int = MOST_PINS) -> DataFrame:
    """Pin each range (file_id, first, last), or unpin it if its first line is pinned; of a
    longer range its first `most` lines."""
    ranges = ranges.select("file_id", "first", F.least(F.col("last"), F.col("first") + most - 1).alias("last"))
    pins = pins.select(*KEYS).distinct()
    state = ranges.join(pins.select("file_id", F.col("line_no").alias("first"), F.lit(True).alias("on")), ["file_id", "first"], "left")
    lines = state.select("file_id", F.explode(F.sequence("first", "last")).alias("line_no"), F.col("on").isNotNull().alias("on"))
    kept = pins.join(lines.where("on").select(*KEYS), KEYS, "left_anti")
    return kept.union(lines.where("NOT on").select(*KEYS)).distinct()


def drop_overlap(found: DataFrame, resume: int) -> DataFrame:
    """Matches without those of the line that is read again."""
    return found.where(F.col("line_no") != resume)


def overview(rows: DataFrame, counts: DataFrame, height: int, range_lines: int = RANGE_LINES) -> DataFrame:
    """Per file and bucket of a strip `height` high: how many of the rows lie there.

    counts: (file_id, line_count). A line lies at floor(line_no * height / line_count). Rows
    meet their file's count by range, so that one file isn't one key.
    """
    bucket = F.floor(F.col("line_no") * height / F.col("line_count"))
    counts = over_ranges(counts.select("file_id", "line_count"), F.lit(0).cast("long"), F.col("line_count") - 1, range_lines)
    return ranged(rows, range_lines).join(counts, ["file_id", "_range"]).groupBy("file_id", bucket.cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def line_of_place(counts: DataFrame, y: int, height: int) -> DataFrame:
    """The line that a place of the strip stands for."""
    line = F.floor(F.lit(y) / height * F.col("line_count"))
    return counts.select("file_id", F.greatest(F.lit(0), F.least(line, F.col("line_count") - 1)).cast("long").alias("line_no"))
