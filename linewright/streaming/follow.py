"""Following files: growing ones by byte ranges, rotated ones by new files.

`GrowingFiles` is a streaming source whose offset holds, for each file, the end of its last
whole line, its encoding and its generation, which a rewrite raises. Each batch's ranges are
planned from offsets alone and read by the executors. A part of a line after the last LF waits
until its LF comes, or is flushed on request.

What a stream has to remember of its files (how many lines came before, how far matches went)
is a number for each file, as its offset is, written batch by batch: see `FileState`. Lines
themselves are never grouped by file.
"""

from __future__ import annotations

import json
import threading
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from linewright.functions.encodings import HEAD_BYTES, detect, line_feed_width
from linewright.functions.predicates import Search, in_range, matches
from linewright.sources.ranges import RANGE_BYTES, last_line_end, next_line_end, range_lines
from linewright.sources.stores import listed, open_file, read_text, write_bytes

SCHEMA = "file_id string, generation int, range_start long, range_line long, byte_start long, text string, byte_len long, has_lf boolean"
#: What a batch's ranges, or a state's files, may be to be broadcast.
BROADCAST_ROWS = 200_000
#: Short ranges are read by one task up to so many bytes.
TASK_BYTES = 2 << 20
REGISTERING = threading.Lock()


class FileRewritten(RuntimeError):
    """A followed file became shorter, or its beginning changed."""


class Range:
    def __init__(self, path: str, start: int, end: int, first: bool, to: dict):
        self.path, self.start, self.end, self.first, self.to = path, start, end, first, to


class Ranges(InputPartition):
    """What one task reads: a long range, or short ones of many files, so that a limited batch
    takes no task for each file that grew."""

    def __init__(self, ranges: list[Range]):
        self.ranges = ranges


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options):
        self.pattern = options["path"]
        self.flush = options.get("flush", "false").lower() == "true"
        self.on_truncate = options.get("on_truncate", options.get("onTruncate", "reset"))
        self.range_bytes = -(-int(options.get("range_bytes", RANGE_BYTES)) // 4) * 4
        self.max_bytes = int(options["max_bytes"]) if options.get("max_bytes") else None
        self.encoding, self.fallback = options.get("encoding"), options.get("fallback", "windows-1252")
        self.state = options.get("state")
        self.known: dict[str, dict] | None = None
        self.looked: dict[str, tuple] = {}

    def initialOffset(self) -> dict:
        return {}

    def _coding(self, stream, size: int) -> tuple[str, int]:
        found, width = detect(stream.read_at(min(HEAD_BYTES, size), 0), self.fallback)
        if self.encoding is None:
            return found, width
        return self.encoding, width if found.upper() == self.encoding.upper() else 0

    def latestOffset(self) -> dict:
        if self.known is None:
            self.known = json.loads(read_text(f"{self.state}/offsets.json") or "{}") if self.state else {}
        known = self.known
        # a file that has gone keeps its generation, so that one that comes in its place gets another
        out = {path: was | {"end": 0, "head": 0, "mark": 0, "gone": True} for path, was in known.items()}
        waiting = []
        for path, size, changed in listed(self.pattern):
            if path in known and self.looked.get(path) == (size, changed, known[path]["end"]):
                out[path] = known[path]
            else:
                waiting.append((path, size, changed))
        share = None if self.max_bytes is None else max(self.max_bytes // max(len(waiting), 1), 1)
        for path, size, changed in waiting:
            out[path] = self._grown(path, size, known.get(path), share)
            self.looked[path] = size, changed, out[path]["end"]
            if out[path]["end"] < size and share is not None:
                del self.looked[path]
        self.known = out
        return out

    def _grown(self, path: str, size: int, was: dict | None, share: int | None) -> dict:
        with open_file(path) as stream:
            size = min(size, stream.size())
            goes_on = was is not None and not was.get("gone") and self._goes_on(stream, size, was)
            if was and not goes_on and was["end"] and self.on_truncate == "fail":
                raise FileRewritten(path)
            start = was["end"] if goes_on else 0
            # what is known of a file's encoding may change until its first line is there
            encoding, bom = (was["encoding"], was["bom"]) if start else self._coding(stream, size)
            width = line_feed_width(encoding)
            whole = size - size % width
            stop = whole if share is None else min(whole, start + max(share - share % width, width))
            end = stop if self.flush and stop == whole else last_line_end(stream, start, stop, encoding)
            if end == start and stop < whole:
                # a line longer than the limit comes alone
                end = next_line_end(stream, stop, whole, encoding) or (whole if self.flush else start)
            head = min(end, HEAD_BYTES)
            generation = 0 if was is None else was["generation"] + (not goes_on)
            return {"end": end, "head": head, "mark": zlib.crc32(stream.read_at(head, 0)), "encoding": encoding, "bom": bom, "generation": generation}

    @staticmethod
    def _goes_on(stream, size: int, was: dict) -> bool:
        return size >= was["end"] and zlib.crc32(stream.read_at(was["head"], 0)) == was["mark"]

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # this offset is in the stream's log: what comes next goes on from it, in this run or another
        self.known = end
        if self.state:
            write_bytes(f"{self.state}/offsets.json", json.dumps(end).encode())
        ranges = []
        for path, to in sorted(end.items()):
            was = start.get(path)
            if was == to or not to["end"]:
                continue
            begin = 0
            if was is not None and was["end"] and was["generation"] <= to["generation"]:
                with open_file(path) as stream:
                    begin = was["end"] if to["end"] >= was["end"] and self._goes_on(stream, to["end"], was) else 0
                if not begin and self.on_truncate == "fail":
                    raise FileRewritten(path)
            for at in range(begin, to["end"], self.range_bytes):
                ranges.append(Range(path, at, min(at + self.range_bytes, to["end"]), at == begin, to))
        parts, room = [], 0
        for own in ranges:
            size = own.end - own.start
            if size > room:
                parts.append([])
                room = min(TASK_BYTES, self.range_bytes)
            parts[-1].append(own)
            room -= size
        return [Ranges(own) for own in parts]

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        """The lines that begin in the ranges; one that runs on is read to its end."""
        for own in part.ranges:
            to = own.to
            for rows in range_lines(own.path, own.start, own.end, to["end"], own.first, to["encoding"], to["bom"]):
                n = len(rows)
                named = [pa.array([own.path] * n, pa.string()), pa.array([to["generation"]] * n, pa.int32())]
                yield pa.RecordBatch.from_arrays([*named, *rows.columns], ["file_id", "generation", *rows.schema.names])

    def commit(self, end: dict) -> None:
        pass


class GrowingFiles(DataSource):
    """spark.readStream.format("growing_files").option("flush", ...).load(file, folder or pattern)"""

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options)


def follow_lines(spark: SparkSession, path: str, flush: bool = False, on_truncate: str = "reset", max_bytes: int | None = None, state: str | None = None, encoding: str | None = None, **options) -> DataFrame:
    """A stream of the lines appended to files (SCHEMA), each once and in order within a file.

    on_truncate: `reset` reads a rewritten or shortened file from its beginning, as a further
    generation, `fail` ends the stream. flush emits the part of a line at a file's end (has_lf
    false) at once; what is appended to it later comes as a line that begins inside it.
    max_bytes limits a batch, shared evenly by the files that grew, but for lines that are
    longer; with the trigger availableNow, which plans one batch, a run takes that much. state
    names a folder of the shared store in which generations outlive the stream's process;
    without it they are counted from 0 again when a stream is restarted. Each file's encoding
    is detected at its first line unless one is given; LFs are looked for at whole characters.
    range_line numbers a range's lines from 0: see `Numbering`.
    """
    given = {"flush": str(flush).lower(), "on_truncate": on_truncate, "max_bytes": max_bytes, "state": state, "encoding": encoding} | options
    # streams may be made side by side, and a name is registered by one at a time
    with REGISTERING:
        spark.dataSource.register(GrowingFiles)
        reader = spark.readStream.format("growing_files")
        for name, value in given.items():
            reader = reader.option(name, str(value)) if value is not None else reader
        return reader.load(path)


def follow_new_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the lines of files as they appear in a folder (rotated, not growing)."""
    return spark.readStream.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file_id"), F.col("value").alias("text"))


class FileState:
    """A number for each file, written by each batch of a stream to a shared folder.

    Two places take turns, so that a batch that is run again finds what the batch before it
    left; each tells which batch wrote it. The driver holds the numbers as it holds the files'
    offsets: no job reads or writes them.
    """

    def __init__(self, folder: str, value: str):
        self.folder, self.value = folder, value
        self.schema = pa.schema([("file_id", pa.string()), ("generation", pa.int32()), (value, pa.int64())])
        self.held: tuple[int, dict] = (-1, {})

    def values(self, batch: int) -> dict[str, tuple[int, int]]:
        """What the batch before left: (generation, the number) of each file."""
        if batch == 0:
            return {}
        if self.held[0] != batch - 1:
            left = json.loads(read_text(f"{self.folder}/{(batch - 1) % 2}.json") or "{}")
            if left.get("batch") != batch - 1:
                raise ValueError(f"{self.folder} doesn't hold the state after batch {batch - 1}")
            self.held = batch - 1, {path: tuple(value) for path, value in left["files"].items()}
        return self.held[1]

    def before(self, spark: SparkSession, batch: int) -> DataFrame:
        """What the batch before left: (file_id, generation, the number)."""
        return _local(spark, [(path, *value) for path, value in self.values(batch).items()], self.schema)

    def keep(self, values: dict[str, tuple[int, int]], batch: int) -> None:
        """Leave the numbers for the next batch."""
        write_bytes(f"{self.folder}/{batch % 2}.json", json.dumps({"batch": batch, "files": values}).encode())


def _local(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """Rows of the driver as a relation that takes no job; broadcast if they are few."""
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    table = pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
    df = spark.createDataFrame(table)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


class Numbering:
    """Line numbers that run on from batch to batch, for foreachBatch: called with a batch of
    followed lines and its number, it gives the batch with line_no.

    Each range counts its lines; a running sum over a file's ranges, on top of what the file
    had before, gives the number at which each begins, and a line's place in its range gives the
    rest. So the lines of one file are numbered by as many tasks as there are ranges, and none
    is shuffled; the counts, one for each range that the driver planned, go to the driver. A
    generation is numbered from 0; a line that begins inside one already given (flush) has its
    number.
    """

    BASE = pa.schema([("file_id", pa.string()), ("generation", pa.int32()), ("range_start", pa.int64()), ("_base", pa.int64())])

    def __init__(self, folder: str):
        self.state = FileState(folder, "lines")

    def __call__(self, batch: DataFrame, number: int) -> DataFrame:
        key = ["file_id", "generation", "range_start"]
        counts = batch.groupBy(*key).agg(F.count_if("has_lf").alias("n")).collect()
        lines, base = dict(self.state.values(number)), []
        for path, generation, start, n in sorted(counts):
            last, upto = lines.get(path, (generation, 0))
            upto = upto if last == generation else 0
            base.append((path, generation, start, upto))
            lines[path] = generation, upto + n
        self.state.keep(lines, number)
        rows = batch.join(_local(batch.sparkSession, base, self.BASE), key)
        return rows.select("file_id", "generation", (F.col("_base") + F.col("range_line")).alias("line_no"), "text", "byte_start", "byte_len", "has_lf")


class OnceEach:
    """Rows of followed lines without those that a repeated read brings again, for foreachBatch:
    what begins before the end of the last row that came of a file and generation is dropped.
    Remembered is a number for each file, however many rows came. The rows are shuffled once,
    when they are used; the ends are found from their places alone."""

    def __init__(self, folder: str):
        self.state = FileState(folder, "upto")

    def __call__(self, batch: DataFrame, number: int) -> DataFrame:
        file = ["file_id", "generation"]
        ends = dict(self.state.values(number))
        last = self.state.before(batch.sparkSession, number).select("file_id", F.col("generation").alias("_last"), F.col("upto").alias("_upto"))
        new = F.col("_last").isNull() | (F.col("generation") > F.col("_last")) | ((F.col("generation") == F.col("_last")) & (F.col("byte_start") >= F.col("_upto")))
        fresh = batch.join(last, "file_id", "left").where(new).drop("_last", "_upto")
        found = fresh.groupBy(*file).agg(F.max(F.col("byte_start") + F.col("byte_len") + F.col("has_lf").cast("int")))
        for path, generation, upto in found.collect():
            ends[path] = max(ends.get(path, (-1, 0)), (generation, upto))
        self.state.keep(ends, number)
        return fresh.dropDuplicates([*file, "byte_start"])


def follow_search(lines: DataFrame, search: Search, resume: int | None = None) -> DataFrame:
    """The appended lines that match; `resume` leaves out matches of a line that is read again."""
    search.checked(lines.sparkSession)
    found = lines.where(matches(F.col("text"), search))
    if "line_no" in lines.columns:
        found = found.where(in_range(F.col("line_no"), search.start, search.end))
        found = found if resume is None else found.where(F.col("line_no") != resume)
    return found


def running_counts(lines: DataFrame, search: Search) -> DataFrame:
    """Per file (and generation, where lines have one), over all batches so far: matches and
    processed_lines (update or complete mode)."""
    hit = matches(F.col("text"), search.checked(lines.sparkSession))
    keys = [k for k in ("file_id", "generation") if k in lines.columns]
    return lines.groupBy(*keys).agg(F.count_if(hit).alias("matches"), F.count("*").alias("processed_lines"))
