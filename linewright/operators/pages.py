"""Long lines in segments, pages by bytes, and selections as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.operators.ranks import RANGE_LINES, over_ranges, ranged, running


def segment_lines(lines: DataFrame, budget: int) -> DataFrame:
    """(file_id, line_no, segment, byte_offset, bytes, next_offset, done): each line's bytes in
    pieces of at most `budget`. An empty line is one empty, done piece."""
    whole = lines.select("file_id", "line_no", F.col("text").cast("binary").alias("_raw"))
    sized = whole.select("file_id", "line_no", "_raw", F.octet_length("_raw").alias("_size"))
    starts = F.sequence(F.lit(0), F.greatest(F.col("_size") - 1, F.lit(0)), F.lit(budget))
    pieces = sized.select("file_id", "line_no", "_raw", "_size", F.posexplode(starts).alias("segment", "byte_offset"))
    end = F.least(F.col("byte_offset") + budget, F.col("_size"))
    return pieces.select("file_id", "line_no", "segment", "byte_offset", F.substring("_raw", F.col("byte_offset") + 1, F.lit(budget)).alias("bytes"), end.alias("next_offset"), (end == F.col("_size")).alias("done"))


def page_by_bytes(lines: DataFrame, start: int, budget: int = 8 << 20) -> DataFrame:
    """Each file's longest run of whole lines from `start` on whose bytes, LFs included, fit
    the budget; the first line always comes. Each line before a file's last has a byte at
    least, its LF, so that no line further than the budget comes."""
    rest = lines.where((F.col("line_no") >= start) & (F.col("line_no") <= start + budget))
    size = F.col("byte_len") + F.col("has_lf").cast("int")
    return running(rest, size, "_before").where((F.col("_before") + size <= budget) | (F.col("line_no") == start)).drop("_before")


def selection_text(lines: DataFrame, selections: DataFrame, cap: int = 20_000_000, range_lines: int = RANGE_LINES) -> DataFrame:
    """(file_id, selected, truncated): the text of each selection, lines joined by LF.

    selections: (file_id, first, first_col, last, last_col), columns being places in the
    line, null for whole lines. Text beyond `cap` characters is left out line by line; such
    text then ends in LF. The cap bounds what one row gathers.
    """
    # lines meet selections by range, so that one file isn't one key
    spans = over_ranges(selections, F.greatest(F.col("first"), F.lit(0)).cast("long"), F.col("last").cast("long"), range_lines)
    inside = ranged(lines, range_lines).join(spans, ["file_id", "_range"]).where(F.col("line_no").between(F.col("first"), F.col("last"))).drop("_range")
    whole = F.col("first_col").isNull() | F.col("last_col").isNull()
    begin = F.when(~whole & (F.col("line_no") == F.col("first")), F.least(F.col("first_col"), F.length("text"))).otherwise(0)
    end = F.when(~whole & (F.col("line_no") == F.col("last")), F.least(F.col("last_col"), F.length("text"))).otherwise(F.length("text"))
    pieces = inside.withColumn("piece", F.substring(F.col("text"), begin + 1, F.greatest(end - begin, F.lit(0))))
    size = F.length("piece") + 1
    sized = running(pieces, size.cast("long"), "_before").withColumn("fits", F.col("_before") + F.length("piece") <= cap)
    kept = sized.groupBy("file_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("line_no", "piece")))).alias("parts"),
        F.bool_or(~F.col("fits")).alias("truncated"),
    )
    text = F.array_join(F.col("parts.piece"), "\n")
    return kept.select("file_id", F.when(F.col("truncated") & (F.size("parts") > 0), F.concat(text, F.lit("\n"))).otherwise(text).alias("selected"), "truncated")
