"""Patterns of a linear-time dialect of regular expressions, written as Java reads them."""

from __future__ import annotations

import re
from collections.abc import Iterable

# fixed values: named classes, ASCII only
NAMED = {
    "alnum": "0-9A-Za-z",
    "alpha": "A-Za-z",
    "ascii": r"\x00-\x7F",
    "blank": r"\t\x20",
    "cntrl": r"\x00-\x1F\x7F",
    "digit": "0-9",
    "graph": "!-~",
    "lower": "a-z",
    "print": r"\x20-~",
    "punct": r"!-/:-@\[-`{-~",
    "space": r"\t\n\x0B\f\r\x20",
    "upper": "A-Z",
    "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}
GROUP = re.compile(r"\(\?(?:(P?<\w+>)|[imsxu]*(?:-[imsxu]+)?([:)]))")
ESCAPE = re.compile(r"\\(?:[pP](?:\{[^}]*\}|.)|[xuU]\{[0-9A-Fa-f]+\}|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|[aftnrvAzbBdDsSwW]|[^0-9A-Za-z<>])", re.DOTALL)
CODE = re.compile(r"\\(?:[xuU]\{([0-9A-Fa-f]+)\}|U([0-9A-Fa-f]{8}))")
COUNT = re.compile(r"[*+?]|\{[0-9]+(?:,[0-9]*)?\}")


def _escape(pattern: str, at: int) -> tuple[str, int]:
    found = ESCAPE.match(pattern, at)
    if not found:
        raise ValueError(f"look-around and back-references are not supported, nor is this escape: {pattern[at : at + 2]!r} in {pattern!r}")
    text = found.group()
    code = CODE.fullmatch(text)
    if code:
        text = rf"\x{{{code.group(1) or code.group(2)}}}"
    # a vertical tab here, but any vertical space in Java
    return (r"\x0B" if text == r"\v" else text), found.end()


def _bracket(pattern: str, at: int) -> tuple[str, int]:
    """The class that opens at a place, and the place after it."""
    out, i = ["["], at + 1
    if pattern.startswith("^", i):
        out, i = ["[^"], i + 1
    if pattern.startswith("]", i):
        out, i = [*out, r"\]"], i + 1
    while i < len(pattern):
        named = re.compile(r"\[:(\^?)([a-z]+):\]").match(pattern, i)
        if pattern[i] == "]":
            return "".join(out) + "]", i + 1
        if named and named.group(2) in NAMED:
            out, i = [*out, f"[{named.group(1)}{NAMED[named.group(2)]}]"], named.end()
        elif pattern[i] == "[":
            inner, i = _bracket(pattern, i)
            out.append(inner)
        elif pattern[i] == "\\":
            text, i = _escape(pattern, i)
            out.append(text)
        elif pattern[i : i + 2] in ("--", "~~"):
            raise ValueError(f"differences of classes are not supported: {pattern!r}")
        else:
            out.append(pattern[i])
            i += 1
    raise ValueError(f"a class is not closed: {pattern!r}")


def java_pattern(pattern: str) -> str:
    """The pattern as Java's.

    Named groups become plain ones, named classes their ASCII characters, and a quantifier on
    a quantifier a nested group (Java would take the second for a possessive one). What the
    dialect has not is refused: look-around, back-references, atomic groups, Java's own flags
    and escapes; so are differences of classes, which Java has not.
    """
    out: list[str] = []
    opened: list[int] = []
    atom, i = None, 0
    while i < len(pattern):
        c = pattern[i]
        begin = len(out)
        if c == "\\":
            text, i = _escape(pattern, i)
            out.append(text)
            atom = begin
        elif c == "[":
            text, i = _bracket(pattern, i)
            out.append(text)
            atom = begin
        elif pattern.startswith("(?", i):
            head = GROUP.match(pattern, i)
            if not head:
                raise ValueError(f"look-around and back-references are not supported, nor are other groups of this kind: {pattern!r}")
            out.append("(" if head.group(1) else head.group())
            i = head.end()
            atom = None
            if head.group(2) != ")":
                opened.append(begin)
        elif c == "(":
            opened.append(begin)
            out.append(c)
            atom, i = None, i + 1
        elif c == ")":
            if not opened:
                raise ValueError(f"a bracket is not opened: {pattern!r}")
            out.append(c)
            atom, i = opened.pop(), i + 1
        elif atom is not None and (count := COUNT.match(pattern, i)):
            i = count.end()
            lazy = pattern.startswith("?", i)
            out.append(count.group() + "?" * lazy)
            i += lazy
            if COUNT.match(pattern, i):
                out[atom:] = ["(?:", *out[atom:], ")"]
        else:
            out.append(c)
            atom, i = (None if c == "|" else begin), i + 1
    return "".join(out)


#: ASCII letters that other letters fold to, when case is ignored as Java does.
FOLDED_TO = frozenset("iksIKS")
#: Escapes of one character that stand for another.
PLAIN = {"t": "\t", "n": "\n", "r": "\r", "f": "\f", "v": "\x0b", "a": "\a"}


def required(pattern: str, ignore_case: bool = False) -> tuple[str, ...] | None:
    """Texts of which every match of the pattern holds one; None if nothing can be told.

    With ignore_case they are in lower case, and hold only what no letter beyond ASCII folds to.
    Longer texts are preferred, and the best of what follows one another.
    """
    if re.search(r"\(\?(?![:P<])", pattern):
        return None  # flags change what letters mean
    found, end = _required(pattern, 0, ignore_case)
    return found if end == len(pattern) else None


#: ASCII digits, one at least.
NUMBER = re.compile(r"(?:\[0-9\]|\[\[:digit:\]\])(?:\+|\{[1-9][0-9]*(?:,[0-9]*)?\})?")


def after_number(pattern: str, ignore_case: bool = False) -> str | None:
    """A text that in every match of the pattern stands right behind an ASCII digit; None if
    nothing can be told. With ignore_case it is as those of required()."""
    found = NUMBER.match(pattern)
    if not found or "|" in pattern or re.search(r"\(\?(?![:P<])", pattern):
        return None
    rest, run = pattern[found.end() :], ""
    for c in rest:
        if c in "\\.^$?*+()[]{}" or ignore_case and (not c.isascii() or c in FOLDED_TO):
            break
        run += c.lower() if ignore_case else c
    # what a quantifier follows may be left out
    if len(run) < len(rest) and rest[len(run)] in "?*+{":
        run = run[:-1]
    return run or None


def _better(a: tuple[str, ...] | None, b: tuple[str, ...] | None) -> tuple[str, ...] | None:
    weight = lambda texts: (min(map(len, texts)), -len(texts)) if texts else (0, 0)
    return a if weight(a) >= weight(b) else b


def _required(pattern: str, at: int, ignore_case: bool) -> tuple[tuple[str, ...] | None, int]:
    """What the alternatives from a place on need, up to the bracket that closes them."""
    every: tuple[str, ...] | None = ()
    best, run = None, ""

    def alternative() -> None:
        nonlocal every, best, run
        own = _better(best, (run,) if run else None)
        every = None if every is None or own is None else every + own
        best, run = None, ""

    while at < len(pattern) and pattern[at] != ")":
        c, text, inner = pattern[at], None, None
        if c == "|":
            alternative()
            at += 1
            continue
        if c == "(":
            head = GROUP.match(pattern, at)
            inner, at = _required(pattern, head.end() if head else at + 1, ignore_case)
            at += 1
        elif c == "[":
            _, at = _bracket(pattern, at)
        elif c == "\\":
            escaped, at = _escape(pattern, at)
            text = PLAIN.get(escaped[1:], escaped[1] if len(escaped) == 2 and not escaped[1].isalnum() else None)
        else:
            text, at = (None if c in ".^$" else c), at + 1
        least = 1
        while count := COUNT.match(pattern, at):
            digits = re.match(r"\{([0-9]+)", count.group())
            least = min(least, 0 if count.group() in "*?" else int(digits.group(1)) if digits else 1)
            at = count.end() + pattern.startswith("?", count.end())
            text = text and (text + "\0" if least else None)
        if text and ignore_case and (not text[0].isascii() or text[0] in FOLDED_TO):
            text = None
        if text:
            run += text[0].lower() if ignore_case else text[0]
        if text is None or len(text) > 1:
            # what follows need not come right after
            best, run = _better(best, (run,) if run else None), ""
        if inner is not None and least:
            best = _better(best, inner)
    alternative()
    return every or None, at


def trie(literals: Iterable[str]) -> str:
    """A Java expression that finds a place where one of the literals begins, branching on one
    character after another, so that their number hardly counts. Of those that begin another
    the shorter suffices."""
    root: dict = {}
    for literal in literals:
        node = root
        for c in literal:
            if node is None:
                break
            parent, node = node, node.setdefault(c, {})
        else:
            parent[literal[-1]] = None

    def written(node: dict) -> str:
        leaves = "".join(f"\\x{{{ord(c):x}}}" for c, child in sorted(node.items()) if child is None)
        parts = [f"[{leaves}]"] if leaves else []
        for c, child in sorted((c, n) for c, n in node.items() if n is not None):
            text = f"\\x{{{ord(c):x}}}"
            while child is not None and len(child) == 1:  # one way on
                (c, child), text = next(iter(child.items())), text
                text += f"\\x{{{ord(c):x}}}"
            parts.append(text if child is None else text + written(child))
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return written(root)
