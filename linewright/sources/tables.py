"""Lines from the text column of any table: each row is a file, its text is split on LF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_lines(text: Column) -> Column:
    """The text's lines: LF ends a line, CR is content, a last LF starts no further line, and
    an empty text has no line."""
    body = F.when(text.endswith("\n"), F.left(text, F.length(text) - 1)).otherwise(text)
    return F.when(text != "", F.split(body, "\n", -1))


def split_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(file_id, _lf, _lines, _n) of the texts that have lines: each split once, before its lines part.

    Texts are chosen by a filter that the scan can take; a generator that drops rows would have
    them chosen by splitting each text once more.
    """
    text = F.col(text_col)
    whole = df.where(text != "").select(F.col(id_col).alias("file_id"), text.endswith("\n").alias("_lf"), split_lines(text).alias("_lines"))
    return whole.select("file_id", "_lf", "_lines", F.size("_lines").alias("_n"))


def line_columns(text: str = "text") -> list[Column]:
    """The columns of lines after file_id, beside _lf and _n of their texts and a line_no."""
    return [F.col("line_no").cast("long").alias("line_no"), F.col(text).alias("text"), F.octet_length(text).cast("long").alias("byte_len"), ((F.col("line_no") < F.col("_n") - 1) | F.col("_lf")).alias("has_lf")]


def lines_from_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(file_id, line_no, text, byte_len, has_lf): a row for each line, numbered from 0.

    A null or empty text has no lines. byte_len is the UTF-8 length without the LF; has_lf is
    false only for a last line that no LF ends.
    """
    rows = split_table(df, id_col, text_col).select("file_id", "_lf", "_n", F.posexplode_outer("_lines").alias("line_no", "text"))
    return rows.select("file_id", *line_columns())


def hits_from_table(df: DataFrame, id_col: str, text_col: str, hit: Callable[[Column, Column], Column]) -> DataFrame:
    """split_table() with _hits: the numbers, in order, of a text's lines that hit(line, number) takes."""
    whole = split_table(df, id_col, text_col)
    place = F.transform("_lines", lambda line, k: F.when(hit(line, k), k))
    return whole.withColumn("_hits", F.array_compact(place))


def lines_from_rows(df: DataFrame, id_col: str, line_col: str, text_col: str) -> DataFrame:
    """Lines of a table that already has a row for each line, such as turns of a conversation."""
    return df.select(F.col(id_col).alias("file_id"), F.col(line_col).cast("long").alias("line_no"), F.col(text_col).alias("text"), F.octet_length(text_col).cast("long").alias("byte_len"), F.lit(True).alias("has_lf"))
