"""Lines of a byte range of a file, in any encoding: LFs are looked for at whole characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from linewright.functions.encodings import line_feed_width, python_codec
from linewright.sources.stores import open_file

#: Bytes of one range, and of what is read at once.
RANGE_BYTES, STEP = 32 << 20, 1 << 20
#: What range_lines() gives of each line.
LINE = "range_start long, range_line long, byte_start long, text string, byte_len long, has_lf boolean"


def feeds(raw: bytes, encoding: str) -> np.ndarray:
    """Where lines end in bytes that begin at a character: places behind each LF."""
    width = line_feed_width(encoding)
    order = ">" if encoding.upper().endswith("BE") else "<"
    units = np.frombuffer(raw, f"{order}u{width}", len(raw) // width)
    return (np.flatnonzero(units == 10) + 1) * width


def last_line_end(stream, start: int, size: int, encoding: str) -> int:
    """The place behind the last LF of [start, size), or start; read from the end, in steps."""
    while size > start:
        begin = max(start, size - STEP)
        ends = feeds(stream.read_at(size - begin, begin), encoding)
        if len(ends):
            return begin + int(ends[-1])
        size = begin
    return start


def next_line_end(stream, start: int, size: int, encoding: str) -> int | None:
    """The place behind the first LF of [start, size)."""
    for begin in range(start, size, STEP):
        ends = feeds(stream.read_at(min(STEP, size - begin), begin), encoding)
        if len(ends):
            return begin + int(ends[0])
    return None


def range_lines(path: str, start: int, end: int, stop: int, first: bool, encoding: str, bom: int) -> Iterator[pa.RecordBatch]:
    """The lines (LINE) that begin in [start, end) of a file that counts as far as `stop`; one
    that runs on is read to its end. `first` tells that a line begins at the start; else the
    range before has the line that goes on into this one. Invalid bytes become U+FFFD; a
    byte-order mark of `bom` bytes is no content. range_line counts from 0."""
    number, at = 0, start
    with open_file(path) as stream:
        if not first:
            at = next_line_end(stream, at - line_feed_width(encoding), stop, encoding) or stop
        begin, pieces = at, []  # the first line not yet given, and its bytes so far
        while begin < end and at < stop and (raw := stream.read_at(min(STEP, stop - at), at)):
            ends = at + feeds(raw, encoding)
            at += len(raw)
            if at >= stop and (not len(ends) or ends[-1] < stop):
                ends = np.append(ends, stop)
            pieces.append(raw)
            if not len(ends):
                continue
            held = b"".join(pieces)
            starts = np.append([begin], ends[:-1])
            own = starts < end
            yield _rows(held, begin, start, starts[own], ends[own], encoding, bom, number)
            number += int(own.sum())
            if not own.all():
                return
            pieces, begin = [held[int(ends[-1]) - begin :]], int(ends[-1])


def _rows(held: bytes, base: int, range_start: int, starts: np.ndarray, ends: np.ndarray, encoding: str, bom: int, number: int) -> pa.RecordBatch:
    codec = python_codec(encoding)
    feed = "\n".encode(codec)
    texts, places, sizes, fed = [], [], [], []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        line = held[a - base : b - base]
        ended = line.endswith(feed)
        mark = bom if a == 0 else 0
        body = line[mark : len(line) - len(feed) * ended]
        texts.append(body.decode(codec, "replace"))
        places.append(a + mark)
        sizes.append(len(body))
        fed.append(ended)
    n = len(texts)
    columns = [pa.array([range_start] * n, pa.int64()), pa.array(range(number, number + n), pa.int64()), pa.array(places, pa.int64()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(fed, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, ["range_start", "range_line", "byte_start", "text", "byte_len", "has_lf"])
