"""Labelled documents for the classifiers: all of them, or bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import fresh, unit_hash


#: Labelled ids are broadcast up to this many (12 bytes each), and shuffled beyond.
BROADCAST_LABELS = 1_000_000


def labelled_ids(labels: DataFrame, label: str, known: Column, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label) of the ids where `known` (an expression over the id) holds; labels other
    than 0 and 1 are none; of several labels of one id the least counts."""
    marks = fresh(labels.where(known), F.col(id_col).alias("doc_id"), F.col(label).alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    return marks.groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))


def labelled_documents(docs: DataFrame, labels: DataFrame, label: str, known: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of every labelled document, by labelled_ids; of several texts of
    an id the first by order."""
    marks = labelled_ids(labels, label, known, id_col)
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_LABELS else marks
    texts = fresh(docs, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = texts.join(marks, "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, known: Column, rows: int, seed: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label) of at most `rows` labelled documents of each class, and the
    numbers of all labelled ones by class.

    Ids and labels are those of labelled_ids; of several texts of an id the first by order
    counts. The sample is the first in a seeded hash order; a threshold on the hash thins the
    classes before they are sorted.
    """
    marks = labelled_ids(labels, label, known, id_col).withColumn("h", unit_hash(F.col("doc_id"), seed))
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    share = F.col("h").cast("double") / F.lit(2.0**64) + 0.5
    picked = None
    for value, n in sorted(counts.items()):
        part = marks.where((F.col("label") == value) & (share * n <= 1.2 * rows + 50)).orderBy("h").limit(rows)
        picked = part if picked is None else picked.unionByName(part)
    if picked is None:
        picked = marks.limit(0)
    texts = fresh(docs, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # at most 2 * rows ids, and one row of each however often an id is there
    found = texts.join(F.broadcast(picked.select("doc_id", "label")), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label"), counts
