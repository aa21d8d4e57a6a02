"""Encodings of text files: detection from a file's first bytes, names, and lossy decoding."""

from __future__ import annotations

import codecs

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Byte-order marks by encoding, the longer ones first.
MARKS = (("UTF-8", b"\xef\xbb\xbf"), ("UTF-32LE", b"\xff\xfe\x00\x00"), ("UTF-32BE", b"\x00\x00\xfe\xff"), ("UTF-16LE", b"\xff\xfe"), ("UTF-16BE", b"\xfe\xff"))

#: How many first bytes of a file are looked at.
HEAD_BYTES = 64 * 1024


def line_feed_width(encoding: str) -> int:
    """Bytes of one LF."""
    return {"UTF-16LE": 2, "UTF-16BE": 2, "UTF-32LE": 4, "UTF-32BE": 4}.get(encoding.upper(), 1)


def python_codec(encoding: str) -> str:
    """Python's name of an encoding; its UTF-16LE and the like keep byte-order marks, as ours do."""
    return codecs.lookup(encoding).name


def _zero_pattern(head: bytes) -> str | None:
    """Wide encodings of mostly ASCII text show as zero bytes at fixed places of each four."""
    if len(head) < 8:
        return None
    zeros = [head[k::4].count(0) for k in range(4)]
    half, most = len(head) // 4, len(head) // 8
    if zeros[1] + zeros[3] > half:
        return "UTF-32LE" if min(zeros[1:]) > most else "UTF-16LE"
    if zeros[0] + zeros[2] > half:
        return "UTF-32BE" if min(zeros[:3]) > most else "UTF-16BE"
    return None


def detect(head: bytes, fallback: str = "windows-1252") -> tuple[str, int]:
    """(encoding, width of the byte-order mark) from a file's first bytes: the mark, else zero
    bytes, else UTF-8 if valid (a character that the head's end cuts is no fault), else the
    fallback."""
    for name, mark in MARKS:
        if head.startswith(mark):
            return name, len(mark)
    if wide := _zero_pattern(head):
        return wide, 0
    for cut in range(4):
        try:
            head[: len(head) - cut].decode("utf-8")
        except UnicodeDecodeError as error:
            if error.end < len(head) - cut:
                break
            continue
        return "UTF-8", 0
    return fallback, 0


def encoding_name(encoding: Column) -> Column:
    """The name to show: UTF-8, UTF-16 LE and so on; other names as they are."""
    shown = F.create_map(*[F.lit(x) for name in ("UTF-16LE", "UTF-16BE", "UTF-32LE", "UTF-32BE") for x in (name, f"{name[:-2]} {name[-2:]}")])
    upper = F.upper(encoding)
    return F.when(upper.isin("UTF-8", "UTF8"), "UTF-8").otherwise(F.coalesce(F.try_element_at(shown, upper), encoding))


def decode_lossy(raw: Column, encoding: str) -> Column:
    """Text of raw bytes; what isn't valid becomes U+FFFD."""
    if encoding.upper() in ("UTF-8", "UTF8"):
        return F.make_valid_utf8(raw.cast("string"))
    return F.decode(raw.cast("binary"), encoding)
