"""How a line is shown: carriage returns, tabs, columns, sizes and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_cr(text: Column) -> Column:
    """Without one CR at the end."""
    return F.when(text.endswith("\r"), F.left(text, F.length(text) - 1)).otherwise(text)


def expand_tabs(text: Column, stop: int) -> Column:
    """Tabs as spaces up to the next multiple of `stop` characters; as it is if stop <= 0."""
    if stop <= 0:
        return text
    parts = F.split(text, "\t", -1)
    rest = F.slice(parts, F.lit(2), F.size(parts))
    fold = lambda acc, part: F.concat(acc, F.repeat(F.lit(" "), F.lit(stop) - F.length(acc) % stop), part)
    return F.when(F.contains(text, F.lit("\t")), F.aggregate(rest, F.get(parts, 0), fold)).otherwise(text)


def display_line(text: Column, stop: int = 0) -> Column:
    """The line as shown: without its CR, tabs expanded."""
    return expand_tabs(strip_cr(text), stop)


def _located(text: Column, stop: int, known: str, wanted: str, at: Column) -> Column:
    """Between places in the line (raw) and where they are shown (shown), in one pass over the
    pieces between tabs: the `wanted` place of the last character whose `known` place is at most
    `at`, or of the line's end. A place inside a tab is the tab's own."""
    start = F.struct(F.lit(0).alias("raw"), F.lit(0).alias("shown"), F.lit(0).alias("found"))

    def step(acc: Column, part: Column) -> Column:
        size = F.length(part)
        inside = F.greatest(F.least(at.cast("int") - acc[known], size), F.lit(0))
        found = F.when(acc[known] <= at, acc[wanted] + inside).otherwise(acc["found"])
        shown = acc["shown"] + size
        return F.struct((acc["raw"] + size + 1).alias("raw"), (shown + (stop - shown % stop)).alias("shown"), found.alias("found"))

    return F.aggregate(F.split(text, "\t", -1), start, step, lambda acc: acc["found"])


def display_column(text: Column, at: Column, stop: int) -> Column:
    """Where the character at place `at` is shown; places beyond the end are the end."""
    return at if stop <= 0 else _located(text, stop, "raw", "shown", at)


def remap_spans(text: Column, spans: Column, stop: int) -> Column:
    """Spans of the line as spans of what is shown."""
    move = lambda at: display_column(text, at, stop).cast("int")
    return F.transform(spans, lambda s: F.struct(move(s["start"]).alias("start"), move(s["end"]).alias("end")))


def raw_range(text: Column, start: Column, end: Column, stop: int) -> Column:
    """The line's span for a range of what is shown: each end goes to the last character that
    begins at or before it, so a place inside a tab is the tab's own. Places beyond the end
    are the end."""
    place = lambda at: (_located(text, stop, "shown", "raw", at) if stop > 0 else F.least(F.greatest(at, F.lit(0)), F.length(text))).cast("int")
    return F.struct(place(start).alias("start"), place(end).alias("end"))


def human_bytes(size: Column) -> Column:
    """1.5 KiB and so on, halves to the even digit; whole bytes below 1024."""
    units = ("KiB", "MiB", "GiB", "TiB")
    out = F.format_string("%d B", size)
    for k, unit in enumerate(units, 1):
        out = F.when(size >= 1024**k, F.format_string(f"%.1f {unit}", F.bround(size / float(1024**k), 1))).otherwise(out)
    return out


def file_ref(path: Column, line_no: Column) -> Column:
    """name:line, the line counted from 1."""
    name = F.element_at(F.split(path.cast("string"), r"[/\\]"), -1)
    return F.concat(name, F.lit(":"), (line_no + 1).cast("string"))
