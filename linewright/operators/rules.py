"""Highlighting rules: which parts of a line get which colour."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, LongType, StringType, StructField, StructType

from linewright.checkpoints import cut
from linewright.functions.dialect import after_number, required
from linewright.functions.display import expand_tabs, raw_range
from linewright.functions.predicates import LOWER, UPPER, Search, fold_ascii, matches, quoted
from linewright.functions.spans import match_spans

COLOURED = "array<struct<start:int,end:int,color:bigint,priority:int>>"
#: Lines after the first for which a selection makes rules.
MOST_RULES = 200
#: Characters beyond ASCII that fold to ASCII letters when case is ignored as Java does.
ASCII_TOO = frozenset("\u0130\u0131\u017f\u212a")
#: Patterns of a table that are tested on every line, rather than joined to lines.
MOST_COLUMNS = 200
#: Rules' beginnings that are broadcast to where the lines are.
BROADCAST_RULES = 500_000


@dataclass(frozen=True)
class Rule:
    """A pattern, or an anchored range of one line, and its colour."""

    pattern: str
    color: int
    ignore_case: bool = True
    regex: bool = False
    whole_line: bool = False
    anchor_line: int | None = None
    anchor_start: int = 0
    anchor_end: int = 0


def _spans(text: Column, line_no: Column, rule: Rule, priority: int) -> Column:
    def coloured(start: Column, end: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(rule.color).cast("bigint").alias("color"), F.lit(priority).alias("priority"))

    none = F.array().cast(COLOURED)
    if rule.anchor_line is not None:
        return F.when(line_no == rule.anchor_line, F.array(coloured(F.lit(rule.anchor_start), F.lit(rule.anchor_end)))).otherwise(none)
    if not rule.pattern.strip():
        return none
    search = Search(rule.pattern, rule.ignore_case, rule.regex)
    if rule.whole_line:
        return F.when(matches(text, search), F.array(coloured(F.lit(0), F.length(text)))).otherwise(none)
    return F.coalesce(F.transform(match_spans(text, search, "chars"), lambda s: coloured(s["start"], s["end"])), none)


def highlight_spans(lines: DataFrame, rules: list[Rule], search: Rule | None = None) -> DataFrame:
    """Adds spans: (start, end, color, priority) of every rule in order; later ones lie above,
    and the search's matches on top. Rules are columns of one projection: nothing is joined."""
    every = [*rules, *([search] if search else [])]
    parts = [_spans(F.col("text"), F.col("line_no"), r, k) for k, r in enumerate(every)]
    return lines.withColumn("spans", F.flatten(F.array(*parts)) if parts else F.array().cast(COLOURED))


def rules_on_lines(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """(file_id, line_no, priority, color) of a table of rules on the lines they apply to.

    rules: (priority, pattern, color, anchor_line) and, if there, ignore_case (else true) and
    regex (else false). Anchored rules meet their line by an equi-join; others, if they are few,
    are searched for in batches of lines, all in one pass. Of many each literal's
    first inner word leads to the lines that hold it, and only those are tested. So does, for
    regular expressions and for literals beyond ASCII that ignore case, a text that each match
    holds; those without one are tested on every line, some at a time. Rules of a blank pattern apply to no line.
    """
    given = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in rules.columns else F.lit(default)
    rules = rules.select("priority", F.col("color").cast("long").alias("color"), "pattern", "anchor_line", given("ignore_case", True).alias("ignore_case"), given("regex", False).alias("regex"))
    anchored = rules.where(F.col("anchor_line").isNotNull()).select("priority", "color", F.col("anchor_line").alias("line_no"))
    out = lines.join(anchored, "line_no").select("file_id", "line_no", "priority", "color")
    free = rules.where(F.col("anchor_line").isNull() & (F.trim("pattern") != ""))
    few = free.limit(MOST_COLUMNS + 1).collect()
    if len(few) <= MOST_COLUMNS:
        return out.unionByName(_met(lines, [r for r in few if r.pattern.strip()], rules.schema["priority"].dataType).select(*out.columns)).distinct()
    fold = lambda c, on: F.when(on, fold_ascii(c)).otherwise(c)
    hit = F.contains(fold(F.col("text"), F.col("ignore_case")), fold(F.col("pattern"), F.col("ignore_case")))
    each = F.col("regex") | (F.col("ignore_case") & F.col("pattern").rlike(r"[^\x00-\x7F]"))
    # an inner word of the pattern is whole in the line too; words meet folded
    words = lambda name: F.expr(f"regexp_extract_all({name}, '[0-9A-Za-z]+', 0)")
    inner = F.slice(words("pattern"), 2, F.greatest(F.size(words("pattern")) - 2, F.lit(0)))
    literals = free.where(~each).withColumn("_word", fold_ascii(F.get(inner, 0)))
    split = lines.select("file_id", "line_no", "text", F.array_distinct(F.transform(words("text"), fold_ascii)).alias("_words"))
    keyed = split.select("file_id", "line_no", "text", F.explode("_words").alias("_word")).join(literals.where(F.col("_word").isNotNull()), "_word")
    out = out.unionByName(keyed.where(hit).select(*out.columns))
    # literals without an inner word: a few are columns of one projection
    short = literals.where(F.col("_word").isNull()).drop("_word")
    few = short.limit(MOST_COLUMNS + 1).collect()
    if 0 < len(few) <= MOST_COLUMNS:
        out = out.unionByName(_tested(lines, few))
    elif few:
        # of many, each meets the lines that hold its first two characters
        short = short.withColumn("_gram", fold_ascii(F.left("pattern", F.least(F.length("pattern"), F.lit(2)))))
        every = F.concat(_grams(F.col("text"), 1), _grams(F.col("text"), 2))
        met = lines.select("file_id", "line_no", "text", F.explode(every).alias("_gram")).join(short, "_gram").where(hit)
        out = out.unionByName(met.select(*out.columns))
    # an expression, of which every match holds some text of three characters, meets the lines
    # that hold the beginning of that text
    compile_rules = F.pandas_udf(_compiled, "java string, needed array<string>")
    compiled = cut(free.where(each).withColumn("_c", compile_rules(F.col("pattern"), F.col("ignore_case"), F.col("regex"))))
    able = compiled.where(F.size("_c.needed") > 0).select("priority", "color", F.col("_c.java").alias("_java"), F.col("_c.needed").alias("_needed"))
    small = F.broadcast if able.count() <= BROADCAST_RULES else (lambda df: df)
    # equal expressions are tested once, and only where the whole text that they need is
    tests = able.select("_java", F.explode("_needed").alias("_text")).distinct().withColumn("_gram", F.left("_text", F.lit(3)))
    met = lines.select("file_id", "line_no", "text", F.explode(_grams(F.col("text"), 3)).alias("_gram")).join(small(tests), "_gram")
    met = met.where(F.when(F.contains(fold_ascii(F.col("text")), F.col("_text")), F.rlike("text", F.col("_java")))).select("file_id", "line_no", "_java")
    out = out.unionByName(met.join(small(able.drop("_needed")), "_java").select(*out.columns))
    # the others come to the driver, as columns that each line is tested by
    listed = compiled.where(F.size("_c.needed") == 0).drop("_c").collect()
    for k in range(0, len(listed), MOST_COLUMNS):
        out = out.unionByName(_tested(lines, listed[k : k + MOST_COLUMNS]))
    return out.distinct()


def _met(lines: DataFrame, listed: list[Row], priority: DataType) -> DataFrame:
    """Lines and the rules that apply to them: (file_id, line_no, priority, color).

    The bytes of a batch of lines are searched for one text after another, at once for all
    lines. Literals are found so; what needs an expression has its lines chosen by a text that
    each match holds, if there is one, and is then tried by Java, expression by expression so
    that each is compiled once for a batch.
    """
    tests = []
    for rule in listed:
        search = Search(rule.pattern, rule.ignore_case, rule.regex)
        exact = not rule.regex and (rule.pattern.isascii() or not rule.ignore_case)
        folds = rule.ignore_case or not exact
        if exact:
            needed = (rule.pattern,)
        else:
            search.checked(lines.sparkSession)
            needed = required(rule.pattern if rule.regex else quoted(rule.pattern), rule.ignore_case) or ()
        texts = [t.translate(str.maketrans(UPPER, LOWER)) if folds else t for t in needed]
        behind = after_number(rule.pattern, rule.ignore_case) if rule.regex else None
        if behind:
            texts = [behind.translate(str.maketrans(UPPER, LOWER))]
        wide = not exact and not rule.regex and any(not c.isascii() and c not in ASCII_TOO for c in rule.pattern)
        tests.append((sorted({t.encode() for t in texts}), folds, exact, wide, behind is not None, None if exact else search.java()))
    wanted = [test[:5] for test in tests]

    def search_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            found, tried = [], []
            text = batch.column("text").cast(pa.large_string())
            ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            raw = (text.buffers()[2] or pa.py_buffer(b""))[int(ends[0]) : int(ends[-1])].to_pybytes()
            places = (ends - ends[0]).tolist()
            folded = raw.lower()  # of bytes, A-Z alone
            beyond = digits = None
            for k, (texts, folds, exact, wide, behind) in enumerate(wanted):
                if behind:
                    if digits is None:
                        units = np.frombuffer(folded, np.uint8)
                        digits = np.flatnonzero((units >= 48) & (units <= 57))
                    own = [_behind(units, digits, texts[0], places)]
                else:
                    own = [_holding(folded if folds else raw, t, places) for t in texts]
                at = np.array(own[0], np.int64) if len(own) == 1 else np.unique(np.concatenate([np.array(o, np.int64) for o in own])) if own else np.arange(len(text))
                if wide:
                    if beyond is None:
                        high = np.flatnonzero(np.frombuffer(raw, np.uint8) > 127)
                        beyond = np.zeros(len(text) + 1, bool)
                        beyond[np.searchsorted(places, high, "right") - 1] = True
                    at = at[beyond[at]]
                (found if exact else tried).append((k, at))
            for some, with_text in ((found, False), (tried, True)):
                if not some:
                    continue
                # rule by rule, some at a time
                for of in range(0, len(some), 16):
                    part = some[of : of + 16]
                    at = pa.array(np.concatenate([at for _, at in part]))
                    which = pa.array(np.concatenate([np.full(len(at), k, np.int32) for k, at in part]))
                    yield pa.RecordBatch.from_arrays([batch.column("file_id").take(at), batch.column("line_no").take(at), which, batch.column("text").take(at) if with_text else pa.nulls(len(at), pa.string())], ["file_id", "line_no", "_rule", "text"])

    rows = lines.where(F.col("text").isNotNull()).select("file_id", "line_no", "text")
    schema = StructType([rows.schema["file_id"], rows.schema["line_no"], StructField("_rule", IntegerType()), StructField("text", StringType())])
    named = [(k, r.priority, r.color, test[5]) for k, (r, test) in enumerate(zip(listed, tests, strict=True))]
    kind = StructType([StructField("_rule", IntegerType()), StructField("priority", priority), StructField("color", LongType()), StructField("_java", StringType())])
    met = rows.mapInArrow(search_batches, schema).join(F.broadcast(lines.sparkSession.createDataFrame(named, kind)), "_rule")
    return met.where(F.col("_java").isNull() | (F.regexp_instr("text", F.col("_java")) > 0))


def _holding(body: bytes, text: bytes, places: list[int]) -> list[int]:
    """The lines, in order, that hold a text; they follow one another in the body, without LFs."""
    out, size = [], len(text)
    at = body.find(text)
    while at >= 0:
        line = bisect_right(places, at) - 1
        if at + size <= places[line + 1]:
            out.append(line)
            at = body.find(text, places[line + 1])
        else:  # astride two lines
            at = body.find(text, at + 1)
    return out


def _behind(units: np.ndarray, digits: np.ndarray, text: bytes, places: list[int]) -> np.ndarray:
    """The lines, in order, in which a text stands right behind one of the digits."""
    at = digits[digits + len(text) < len(units)]
    for k, c in enumerate(text):
        at = at[units[at + 1 + k] == c]
    line = np.searchsorted(places, at, "right") - 1
    return np.unique(line[at + len(text) < np.asarray(places)[line + 1]])


def _grams(text: Column, size: int) -> Column:
    """The distinct runs of `size` characters, folded; what the text's end cuts is null."""

    def runs(chars: Column) -> Column:
        ahead = F.arrays_zip(*[F.slice(chars, k, F.size(chars)) for k in range(1, size + 1)])
        return F.array_distinct(F.transform(ahead, lambda z: F.concat(*[z[str(k)] for k in range(size)])))

    # as the variable of a lambda the text is taken apart once
    return F.transform(F.array(F.split(fold_ascii(text), "")), runs)[0]


def _compiled(patterns: pd.Series, ignore_case: pd.Series, is_regex: pd.Series) -> pd.DataFrame:
    """Each rule's Java expression, and the texts, folded, of which each match holds one; none if
    one of them has less than three characters."""
    rows = []
    for pattern, ignore, regex in zip(patterns, ignore_case, is_regex, strict=True):
        needed = required(pattern if regex else quoted(pattern), ignore) or ()
        folded = sorted({t.translate(str.maketrans(UPPER, LOWER)) for t in needed})
        rows.append((Search(pattern, ignore, regex).java(), folded if all(len(t) > 2 for t in folded) else []))
    return pd.DataFrame(rows, columns=["java", "needed"])


def _tested(lines: DataFrame, listed: list[Row]) -> DataFrame:
    """The rules' patterns as columns of one projection."""

    def found(rule: Row) -> Column:
        if not rule.pattern.strip():
            return F.lit(False)
        return matches(F.col("text"), Search(rule.pattern, rule.ignore_case, rule.regex).checked(lines.sparkSession))

    parts = [F.when(found(r), F.struct(F.lit(r.priority).alias("priority"), F.lit(r.color).cast("bigint").alias("color"))) for r in listed]
    rows = lines.select("file_id", "line_no", F.explode(F.filter(F.array(*parts), lambda s: s.isNotNull())).alias("_r"))
    return rows.select("file_id", "line_no", F.col("_r.priority").alias("priority"), F.col("_r.color").alias("color"))


def remove_rules(rules: DataFrame, first: int, last: int, selected: str | None = None) -> DataFrame:
    """Rules without those anchored in lines [first, last] and those of just the selected text."""
    gone = F.coalesce(F.col("anchor_line").between(first, last), F.lit(False))
    return rules.where(~(gone if selected is None else gone | (F.col("anchor_line").isNull() & (F.col("pattern") == selected))))


def rules_from_selection(lines: DataFrame, file_id, first: int, first_col: int, last: int, last_col: int, color: int, stop: int = 0) -> DataFrame:
    """Rules for a selection of what is shown: (pattern, color, whole_line, anchor_line, anchor_start, anchor_end).

    One line: its selected text, anywhere. Several: the selected part of each line, anchored
    there, for the first line and MOST_RULES more. Nothing selected: the first line as a
    whole. Empty parts make no rule.
    """
    own = lines.where((F.col("file_id") == file_id) & F.col("line_no").between(first, min(last, first + MOST_RULES)))
    shown = expand_tabs(F.col("text"), stop)
    size = F.length(shown)
    begin = F.when(F.col("line_no") == first, F.least(F.lit(first_col), size)).otherwise(0)
    end = F.when(F.col("line_no") == last, F.least(F.lit(last_col), size)).otherwise(size)
    null = F.lit(None)
    if first == last and first_col == last_col:
        return own.where(F.col("text") != "").select(F.col("text").alias("pattern"), F.lit(color).cast("bigint").alias("color"), F.lit(True).alias("whole_line"), null.cast("bigint").alias("anchor_line"), F.lit(0).alias("anchor_start"), F.lit(0).alias("anchor_end"))
    part = F.substring(shown, begin + 1, F.greatest(end - begin, F.lit(0)))
    rows = own.select("line_no", part.alias("pattern"), raw_range(F.col("text"), begin, end, stop).alias("_r")).where(F.col("pattern") != "")
    if first == last:
        return rows.select("pattern", F.lit(color).cast("bigint").alias("color"), F.lit(False).alias("whole_line"), null.cast("bigint").alias("anchor_line"), F.lit(0).alias("anchor_start"), F.lit(0).alias("anchor_end"))
    rows = rows.where(F.col("_r.end") > F.col("_r.start"))
    return rows.select("pattern", F.lit(color).cast("bigint").alias("color"), F.lit(False).alias("whole_line"), F.col("line_no").alias("anchor_line"), F.col("_r.start").alias("anchor_start"), F.col("_r.end").alias("anchor_end"))
