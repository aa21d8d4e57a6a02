"""What changed between two snapshots of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def change_kind(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_id, old_size, new_size, change): Unchanged, DataAdded or Truncated.

    old and new: (file_id, size, head_hash, tail_hash), and prefix_hash in new: the hash of
    as many first bytes as old's head had. A missing file has size 0. A file of the same size
    and hashes is Unchanged; one that grew after an unchanged beginning is DataAdded; anything
    else, smaller or rewritten, is Truncated.
    """
    a = old.select("file_id", F.col("size").alias("old_size"), F.col("head_hash").alias("old_head"), F.col("tail_hash").alias("old_tail"))
    b = new.select("file_id", F.col("size").alias("new_size"), F.col("head_hash").alias("new_head"), F.col("tail_hash").alias("new_tail"), F.col("prefix_hash").alias("prefix"))
    both = a.join(b, "file_id", "full").withColumn("old_size", F.coalesce("old_size", F.lit(0))).withColumn("new_size", F.coalesce("new_size", F.lit(0)))
    same = F.col("old_head").eqNullSafe(F.col("new_head")) & F.col("old_tail").eqNullSafe(F.col("new_tail"))
    kind = (
        F.when((F.col("new_size") == F.col("old_size")) & (same | (F.col("new_size") == 0)), "Unchanged")
        .when((F.col("new_size") > F.col("old_size")) & ((F.col("old_size") == 0) | (F.col("prefix") == F.col("old_head"))), "DataAdded")
        .otherwise("Truncated")
    )
    return both.select("file_id", "old_size", "new_size", kind.alias("change"))
