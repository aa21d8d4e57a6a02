"""Where in a line the matches are."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from linewright.functions.predicates import Search, matches

SPANS = "array<struct<start:int,end:int>>"
#: Matches whose places are summed up together.
BLOCK = 256


def _empty_matches(search: Search) -> bool:
    """Whether the expression can match an empty piece of text somewhere."""
    flags = regex.V1 | (regex.IGNORECASE if search.ignore_case else 0)
    body = "|".join(f"(?:{p if search.regex else regex.escape(p)})" for p in search.patterns).replace("(?<", "(?P<")
    return any(m.start() == m.end() for m in regex.compile(body, flags).finditer("a 1"))


def _blocks(pieces: Column) -> Column:
    """The array in pieces of BLOCK entries."""
    starts = F.sequence(F.lit(1), F.size(pieces), F.lit(BLOCK))
    return F.transform(starts, lambda k: F.slice(pieces, k, F.lit(BLOCK)))


def _placed(pieces: Column) -> Column:
    """(at, spans) of pieces (gap, size) one after another: where the last ends, and all spans."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(acc: Column, piece: Column) -> Column:
        first = acc["at"] + piece["gap"]
        last = first + piece["size"]
        return F.struct(last.alias("at"), F.concat(acc["spans"], F.array(F.struct(first.alias("start"), last.alias("end")))).alias("spans"))

    return F.aggregate(pieces, none, step)


def _sizes(text: Column, search: Search, measure) -> Column:
    """Spans from the pieces between matches and the matches, measured by length or octet_length.

    Sums run within blocks of matches, then over the blocks: what a fold has gathered is copied
    for each entry more, so that one fold over all would take the square of their number.
    """
    pattern = F.lit(search.java())
    both = F.arrays_zip(F.split(text, search.java(), -1), F.regexp_extract_all(text, pattern, F.lit(0)))

    def spans(pieces: Column) -> Column:
        # the piece after the last match has none beside it
        sized = F.transform(F.filter(pieces, lambda p: p["1"].isNotNull()), lambda p: F.struct(measure(p["0"]).alias("gap"), measure(p["1"]).alias("size")))
        return F.transform(F.array(sized), _summed)[0]

    # as variables of lambdas arrays are made once, not once for each entry
    return F.when(matches(text, search), F.transform(F.array(both), spans)[0]).otherwise(F.array().cast(SPANS))


def _summed(pieces: Column) -> Column:
    """Spans of pieces (gap, size), one at least."""
    few = _placed(pieces)["spans"]

    def many(placed: Column) -> Column:
        # each block as one piece, whose place is where its spans begin
        bases = _placed(F.transform(placed, lambda b: F.struct(F.lit(0).alias("gap"), b["at"].alias("size"))))["spans"]
        moved = lambda z: F.transform(z["placed"]["spans"], lambda s: F.struct((z["base"]["start"] + s["start"]).alias("start"), (z["base"]["start"] + s["end"]).alias("end")))
        return F.flatten(F.transform(F.zip_with(placed, bases, lambda x, y: F.struct(x.alias("placed"), y.alias("base"))), moved))

    placed = F.transform(_blocks(pieces), lambda block: _placed(block))
    return F.when(F.size(pieces) <= BLOCK, few).otherwise(F.transform(F.array(placed), many)[0])


def match_spans(text: Column, search: Search, unit: str = "bytes") -> Column:
    """(start, end) of all matches that don't overlap, from left to right, in UTF-8 bytes, or
    in `chars` (UTF-16 units, as editors count). Of several literals that begin at one place
    the first named counts. Null lines have null spans."""
    if _empty_matches(search):
        return F.when(text.isNotNull(), _scanned(search, unit)(text))
    wide = lambda c: F.length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return F.when(text.isNotNull(), _sizes(text, search, F.octet_length if unit == "bytes" else wide))


def _scanned(search: Search, unit: str):
    """For expressions that match empty pieces, which splitting can't show."""
    body = "|".join(f"(?:{p if search.regex else regex.escape(p)})" for p in search.patterns).replace("(?<", "(?P<")
    ignore, size = search.ignore_case, unit

    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = regex.compile(body, regex.V1 | (regex.IGNORECASE if ignore else 0))
        width = (lambda s: len(s.encode("utf-8"))) if size == "bytes" else (lambda s: len(s.encode("utf-16-le")) // 2)
        for batch in batches:
            yield batch.map(lambda t: None if t is None else [{"start": width(t[: m.start()]), "end": width(t[: m.end()])} for m in compiled.finditer(t)])

    spans.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(spans, SPANS)


def byte_to_char_spans(text: Column, spans: Column) -> Column:
    """Byte spans of a line as spans of UTF-16 units."""
    raw = text.cast("binary")

    def units(size: Column) -> Column:
        head = F.decode(F.substring(raw, F.lit(1), size), "UTF-8")
        return (F.length(head) + F.regexp_count(head, F.lit(r"[\x{10000}-\x{10FFFF}]"))).cast("int")

    return F.transform(spans, lambda s: F.struct(units(s["start"]).alias("start"), units(s["end"]).alias("end")))


def ansi(text: Column, search: Search, on: str = "\x1b[0;31m", off: str = "\x1b[0m") -> Column:
    """The line with every match in colour."""
    return F.regexp_replace(text, F.lit(search.java()), F.lit(f"{on}$0{off}"))
