"""Lines, encodings and states of text files, many files at a time."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linewright.checkpoints import cut
from linewright.functions.encodings import HEAD_BYTES, decode_lossy, detect, line_feed_width
from linewright.sources.ranges import LINE, RANGE_BYTES, range_lines
from linewright.sources.stores import open_file

#: Bytes that are hashed at each end of a file.
WINDOW_BYTES = 5 * 1024 * 1024
#: A scan's table of blocks is broadcast up to this many rows.
BROADCAST_BLOCKS = 200_000


def list_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file_id, size): each file of the paths, folders and patterns once."""
    paths = [paths] if isinstance(paths, str) else list(dict.fromkeys(paths))
    found = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file_id"), F.col("length").alias("size"))
    return found.dropDuplicates(["file_id"])


def _literal(path: str) -> str:
    """The path as a pattern that only it fits."""
    return re.sub(r"([\\*?{}\[\]])", r"\\\1", path)


def _spread(files: DataFrame, per_task: int = 64) -> DataFrame:
    return files.repartition(max(1, -(-files.count() // per_task)), "file_id")


def detect_encodings(files: DataFrame, fallback: str = "windows-1252", head_bytes: int = HEAD_BYTES) -> DataFrame:
    """(file_id, size, encoding, bom_width) from the first bytes of each file."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for path in batch["file_id"]:
                with open_file(path) as stream:
                    made.append(detect(stream.read_at(min(head_bytes, stream.size()), 0), fallback))
            yield batch.assign(encoding=[m[0] for m in made], bom_width=[m[1] for m in made])

    return _spread(files).mapInPandas(look, "file_id string, size long, encoding string, bom_width int")


def file_states(files: DataFrame, window: int = WINDOW_BYTES, old: DataFrame | None = None) -> DataFrame:
    """(file_id, size, head_len, head_hash, tail_hash, prefix_hash) without reading whole files.

    With an older table of states, prefix_hash is the hash of as many first bytes as the old
    head had, so that growth after an unchanged beginning can be told from a rewrite.
    """
    files = files.select("file_id", "size")
    lengths = old.select("file_id", F.col("head_len").alias("old_len")) if old is not None else None
    files = files.join(lengths, "file_id", "left") if lengths is not None else files.withColumn("old_len", F.lit(None).cast("long"))

    def mark(raw: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)

    def capture(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, was in zip(batch["file_id"], batch["old_len"], strict=True):
                with open_file(path) as stream:
                    size = stream.size()
                    head = stream.read_at(min(window, size), 0)
                    tail = stream.read_at(min(window, size), max(0, size - window))
                    prefix = None if pd.isna(was) else mark(stream.read_at(min(int(was), size), 0))
                rows.append((path, size, len(head), mark(head), mark(tail), prefix))
            out = pd.DataFrame(rows, columns=["file_id", "size", "head_len", "head_hash", "tail_hash", "prefix_hash"])
            yield out.astype({"prefix_hash": "Int64"})

    return _spread(files).mapInPandas(capture, "file_id string, size long, head_len long, head_hash long, tail_hash long, prefix_hash long")


def _scan(spark: SparkSession, marks: list[tuple[str, int]], encoding: str) -> DataFrame:
    """One scan of files of one encoding, (path, bom width) each: lines numbered without sorting them.

    Each split of a file counts its lines and bytes (a small table), a running sum over a
    file's splits gives the numbers at which they begin, and a line's place within its split
    gives the rest.
    """
    reader = spark.read.option("lineSep", "\n")
    if encoding.upper() not in ("UTF-8", "UTF8"):
        # any charset of the JVM, and lossy decoding
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        spark.conf.set("spark.sql.legacy.codingErrorAction", "true")
        reader = reader.option("encoding", encoding)
    place = F.monotonically_increasing_id()
    # the scan names files by encoded paths, the listing by plain ones
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    raw = reader.text([_literal(path) for path, _ in marks]).select("value", plain.alias("file_id"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), place.alias("place"))
    length = F.octet_length("value").cast("long")
    blocks = raw.groupBy("file_id", "block").agg(F.min("place").alias("first"), F.count("*").alias("n"), F.sum(length + 1).alias("bytes"))
    before = Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select("file_id", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines_before"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"))
    # marks go to the blocks, not to the lines; the scan may write file:/ for file:///
    path = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    named = spark.createDataFrame(marks, "_path string, bom int").withColumn("_path", path("_path"))
    known = F.when(F.col("_path").isNull(), F.raise_error(F.concat(F.lit("a scanned file that was not listed: "), F.col("file_id")))).otherwise(F.col("bom"))
    base = cut(base.join(named, path("file_id") == F.col("_path"), "left").withColumn("bom", known).drop("_path"))
    joined = raw.join(F.broadcast(base) if base.count() <= BROADCAST_BLOCKS else base, ["file_id", "block"])
    inside = F.sum(length + 1).over(Window.partitionBy("file_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    line_no = F.col("place") - F.col("first") + F.col("lines_before")
    return joined.select("file_id", "size", "bom", line_no.alias("line_no"), F.col("value").alias("raw"), length.alias("byte_len"), (F.col("bytes_before") + F.coalesce(inside, F.lit(0))).alias("byte_start"))


def _scan_wide(spark: SparkSession, files: list[dict], encoding: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Lines of files whose LF has several bytes: a search for the bytes alone would also find
    them astride two characters, so ranges are read at whole characters. Each range counts its
    lines, running sums over a file's ranges number them, and a line's place in its range gives the rest."""
    step = -(-range_bytes // 4) * 4
    named = spark.createDataFrame([(f["file_id"], f["size"], f["bom_width"]) for f in files], "file_id string, size long, bom int")
    starts = named.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(step).cast("long"))))
    ranges = starts.repartition(max(1, sum(-(-f["size"] // step) for f in files)), "file_id", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                path, size, bom, start = (c[k].as_py() for c in batch.columns)
                # a line begins at the start of the file alone; elsewhere the range before may have it
                for rows in range_lines(path, start, min(start + step, size), size, start == 0, encoding, bom):
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *rows.columns], ["file_id", *rows.schema.names])

    lines = ranges.mapInArrow(read, f"file_id string, {LINE}")
    counts = cut(lines.groupBy("file_id", "range_start").agg(F.count("*").alias("n")))
    upto = Window.partitionBy("file_id").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)
    base = cut(counts.select("file_id", "range_start", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_base")))
    rows = lines.join(F.broadcast(base) if base.count() <= BROADCAST_BLOCKS else base, ["file_id", "range_start"])
    return rows.select("file_id", (F.col("_base") + F.col("range_line")).alias("line_no"), "text", "byte_start", "byte_len", "has_lf")


def read_lines(spark: SparkSession, paths: str | list[str], encoding: str | None = None, fallback: str = "windows-1252", geometry: bool = True) -> DataFrame:
    """(file_id, line_no, text, byte_start, byte_len, has_lf) of text files, folders or patterns.

    The encoding is detected file by file unless one is given; a byte-order mark that fits it
    is no content. LF alone ends a line and CR is content. byte_start and byte_len are of the
    file's own bytes, CR included and LF not; has_lf is false for a last line without LF.
    Empty files have no lines. Invalid bytes are decoded as U+FFFD. Without `geometry` the
    bytes are left out, and with them the sort within splits that they need.
    """
    found = detect_encodings(list_files(spark, paths), fallback)
    # a row per file, as the list of paths itself
    files = [r.asDict() for r in found.collect()]
    if encoding:
        same = lambda a: a.upper().replace("UTF8", "UTF-8")
        files = [f | {"encoding": encoding, "bom_width": f["bom_width"] if same(f["encoding"]) == same(encoding) else 0} for f in files]
    schema = "file_id string, line_no long, text string" + ", byte_start long, byte_len long, has_lf boolean" * geometry
    out = None
    for name in sorted({f["encoding"] for f in files if f["size"]}):
        own = [f for f in files if f["encoding"] == name and f["size"]]
        if line_feed_width(name) > 1:
            lines = _scan_wide(spark, own, name)
            lines = lines if geometry else lines.drop("byte_start", "byte_len", "has_lf")
            out = lines if out is None else out.unionByName(lines)
            continue
        lines = _scan(spark, [(f["file_id"], f["bom_width"]) for f in own], name)
        # the reader drops a UTF-8 mark itself, and other encodings of one byte for an LF have none
        start = F.col("byte_start") + F.col("bom")
        ended = start + F.col("byte_len") + 1 <= F.col("size")
        lines = lines.select("file_id", "line_no", decode_lossy(F.col("raw"), name).alias("text"), *([start.alias("byte_start"), "byte_len", ended.alias("has_lf")] if geometry else []))
        out = lines if out is None else out.unionByName(lines)
    return out if out is not None else spark.createDataFrame([], schema)


def describe_files(spark: SparkSession, paths: str | list[str], fallback: str = "windows-1252") -> DataFrame:
    """(file_id, size, encoding, bom_width, line_count, max_line_len) of each file; an empty one
    has 0 lines."""
    name = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    found = detect_encodings(list_files(spark, paths), fallback)
    lines = read_lines(spark, paths, fallback=fallback).groupBy(name("file_id").alias("_file")).agg(F.count("*").alias("line_count"), F.max("byte_len").alias("max_line_len"))
    both = found.join(lines, name("file_id") == F.col("_file"), "left")
    return both.select("file_id", "size", "encoding", "bom_width", F.coalesce("line_count", F.lit(0)).alias("line_count"), F.coalesce("max_line_len", F.lit(0)).alias("max_line_len"))
