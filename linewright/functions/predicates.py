"""Line predicates: literals and regular expressions, one or several, with case folding."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from linewright.functions.dialect import java_pattern, required, trie

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: From this many literals on, one expression is tried in place of a chain of searches.
MANY = 16
#: Characters of a needed text that is looked for before the expression is tried.
CHOOSING = 4


def quoted(literal: str) -> str:
    """A regular expression for just this text."""
    return re.sub(r"([\\.^$|?*+()\[\]{}\-#&~])", r"\\\1", literal)


def fold_ascii(text: Column) -> Column:
    """A-Z lower-cased, and nothing else."""
    return F.translate(text, UPPER, LOWER)


@dataclass(frozen=True)
class Search:
    """What to look for: patterns (any of them), as literals or regular expressions.

    start and end restrict line numbers to [start, end); limit caps the number of results.
    """

    patterns: tuple[str, ...] | list[str] | str
    ignore_case: bool = False
    regex: bool = True
    start: int | None = None
    end: int | None = None
    limit: int | None = None

    def __post_init__(self):
        patterns = (self.patterns,) if isinstance(self.patterns, str) else tuple(self.patterns)
        if not patterns or any(not p.strip() for p in patterns):
            raise ValueError("a blank pattern matches nothing worth finding")
        object.__setattr__(self, "patterns", patterns)

    def checked(self, spark) -> Search:
        """Compile the pattern on the driver, so that a bad one is refused before any work."""
        if self.regex:
            try:
                spark.sparkContext._jvm.java.util.regex.Pattern.compile(self.java())
            except Exception as error:
                raise ValueError(f"bad pattern {' | '.join(self.patterns)!r}: {str(error).splitlines()[0]}") from None
        return self

    def java(self) -> str:
        """One Java expression for all patterns; classes are Unicode's and only LF ends a line."""
        parts = [java_pattern(p) if self.regex else quoted(p) for p in self.patterns]
        body = parts[0] if len(parts) == 1 else "|".join(f"(?:{p})" for p in parts)
        if not self.regex:
            ascii_only = all(p.isascii() for p in self.patterns)
            return (("(?i)" if ascii_only else "(?iu)") if self.ignore_case else "") + body
        return ("(?iuUd)" if self.ignore_case else "(?Ud)") + body


def may_match(text: Column, search: Search) -> Column | None:
    """Whether the text holds what every match of one of the expressions needs; None if nothing
    is needed, or too many things, or one so short that most texts hold it."""
    needed = [required(p, search.ignore_case) for p in search.patterns]
    if not all(needed) or sum(map(len, needed)) >= MANY or min(len(n) for some in needed for n in some) < CHOOSING:
        return None
    folded = F.lower(text) if search.ignore_case else text
    return reduce(lambda a, b: a | b, [F.contains(folded, F.lit(n)) for some in needed for n in some])


def matches(text: Column, search: Search) -> Column:
    """Whether the line holds any of the patterns; null lines hold none."""
    simple = not search.regex and len(search.patterns) < MANY
    if simple and not search.ignore_case:
        found = reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in search.patterns])
    elif simple and all(p.isascii() for p in search.patterns):
        needles = [F.lit(p.translate(str.maketrans(UPPER, LOWER))) for p in search.patterns]
        # lower() is fast but folds more (the Kelvin sign to k), so it only chooses what is folded exactly
        found = reduce(lambda a, b: a | b, [F.contains(F.lower(text), n) & F.contains(fold_ascii(text), n) for n in needles])
    elif not search.regex:
        flags = "" if not search.ignore_case else "(?i)" if all(p.isascii() for p in search.patterns) else "(?iu)"
        found = text.rlike(flags + trie(search.patterns))
    else:
        able = may_match(text, search)
        found = text.rlike(search.java())
        # a search for what every match holds is faster than one for the match
        found = found if able is None else able & found
    return F.coalesce(found, F.lit(False))


def in_range(line_no: Column, start: int | None, end: int | None) -> Column:
    """Line numbers of [start, end); nothing if end isn't above start."""
    kept = F.lit(True) if start is None else line_no >= start
    return kept if end is None else kept & (line_no < end)
