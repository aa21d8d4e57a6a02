"""Results as text and JSON."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from linewright.functions.predicates import Search
from linewright.functions.spans import ansi, match_spans
from linewright.operators.context import context_groups


def match_json(path: Column, search: Search) -> Column:
    """One JSON object for a match: type, path, line_number (from 1), lines.text with its LF,
    and the matches' byte spans."""
    return F.to_json(
        F.struct(
            F.lit("match").alias("type"),
            path.cast("string").alias("path"),
            (F.col("line_no") + 1).alias("line_number"),
            F.struct(F.concat("text", F.lit("\n")).alias("text")).alias("lines"),
            match_spans(F.col("text"), search).alias("matches"),
        )
    )


def to_ndjson(found: DataFrame, search: Search) -> DataFrame:
    """(file_id, line_no, json): a row for each match, for write.text after sorting."""
    return found.select("file_id", "line_no", match_json(F.col("file_id"), search).alias("json"))


def render_lines(found: DataFrame, numbers: bool = True, search: Search | None = None) -> DataFrame:
    """(file_id, line_no, rendered): `N:text`, or the text alone; matches in colour if a
    search is given."""
    text = F.col("text") if search is None else ansi(F.col("text"), search)
    return found.select("file_id", "line_no", (F.concat(F.col("line_no").cast("string"), F.lit(":"), text) if numbers else text).alias("rendered"))


def render_context(rows: DataFrame, numbers: bool = True) -> DataFrame:
    """(file_id, line_no, separator, rendered): `N:text` for matches and `N-text` for lines
    around them; separator is `--` where a group begins after another, else null."""
    mark = F.when(F.col("is_match"), ":").otherwise("-")
    text = F.concat(F.col("line_no").cast("string"), mark, "text") if numbers else F.col("text")
    separator = F.when(F.col("starts_group") & (F.col("group_no") > 0), "--")
    return context_groups(rows).select("file_id", "line_no", separator.alias("separator"), text.alias("rendered"))


def info_json(info: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(file_id, json): a file's facts as one object."""
    return info.select("file_id", F.to_json(F.struct(F.col("file_id").cast("string").alias("path"), "size", "line_count", "max_line_len", *extra)).alias("json"))


def batches(found: DataFrame, size: int = 8192) -> Iterator[list[Row]]:
    """Results in line order, `size` at a time; only one partition is at the driver at once."""
    part: list[Row] = []
    for row in found.orderBy("file_id", "line_no").toLocalIterator(prefetchPartitions=True):
        part.append(row)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


def write_text(rendered: DataFrame, path: str, column: str = "rendered") -> None:
    """Write rendered rows as text, in line order across the part files."""
    rendered.orderBy("file_id", "line_no").select(column).write.text(path)
