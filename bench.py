"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs twice after a warm-up scan and counts with its faster run; its whole result
is produced (a noop sink reads every row and column). mib_per_s is the text of `documents`
over that time, for queries that read all of it.

`documents` is one block of one file, which one task reads. `large` times some of the queries
under ids of their own, in many files), on all cores and on a quarter of them: there the fixed
cost of a job weighs little, and tasks share the work.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

HEADLINE = (
    "line_numbering", "file_info", "search_literal", "search_ignore_case", "search_regex", "search_multi_regex", "search_from_offset", "first_n", "count_matches", "search_status",
    "context_lines", "render_context", "match_spans_bytes", "highlight_spans", "rank_of_line", "union_pins", "stride_sample", "page_by_bytes", "tail_n", "scanned_geometry",
)

LARGE = ("line_numbering", "search_literal", "search_ignore_case", "search_multi_regex", "search_from_offset", "first_n", "context_lines", "rank_of_line")
COPIES = 10


def session(cpus: int):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def best_of_two(spark, name: str, folder: str) -> float:
    from linewright.plans.queries import QUERIES

    took = []
    for _ in range(2):
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    return round(min(took), 3)


def large(folder: str, cpus: int, size: float) -> dict:
    from pyspark.sql import functions as F

    out = {"text_mib": round(size * COPIES, 1)}
    with tempfile.TemporaryDirectory() as copied:
        spark = session(cpus)
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        ids = docs.agg(F.max("doc_id")).first()[0] + 1
        copies = docs.crossJoin(spark.range(COPIES).withColumnRenamed("id", "k")).withColumn("doc_id", F.col("doc_id") + F.col("k") * ids).drop("k")
        copies.repartition(4 * cpus).write.parquet(f"{copied}/documents.parquet")
        for cores in (cpus, max(cpus // 4, 1)):
            spark.stop()
            spark = session(cores)
            spark.read.parquet(f"{copied}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()
            took = {name: best_of_two(spark, name, copied) for name in LARGE}
            out[f"cores_{cores}"] = {"seconds": took, "mib_per_s": {n: round(size * COPIES / t, 1) for n, t in took.items()}}
        spark.stop()
    return out


def main() -> None:
    from pyspark.sql import functions as F

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = session(cpus)
    size = spark.read.parquet(f"{folder}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0] / 2**20
    seconds = {name: best_of_two(spark, name, folder) for name in HEADLINE}
    spark.stop()
    speed = {name: round(size / took, 1) for name, took in seconds.items()}
    more = large(folder, cpus, size)
    print(json.dumps({"metric": "headline line queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "mib_per_s": speed, "text_mib": round(size, 1), "cpus": cpus, "sf": Path(folder).name, "large": more}))


if __name__ == "__main__":
    main()
