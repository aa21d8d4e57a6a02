"""The training-corpus pipeline: from `documents` to packed token sequences.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), works on all that
the stage before kept, and returns the next stage's docs. run() applies them to `documents`,
writing each stage's result as Parquet to the folder that all executors share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.checkpoints import shared_folder
from linewright.llm import language_id, mixing, packing, quality, set_join
from linewright.llm.common import cut, table
from linewright.llm.queries import BYTE_BPE, BYTE_RANKS

#: Documents taken out are broadcast up to this many (16 bytes each), and shuffled beyond.
BROADCAST_IDS = 1_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents of no language (null texts and texts without a letter); where `lang`
    is missing, the prediction fills it. Repeated rows are treated alike."""
    predict = language_id.predictor(docs, language_id.held_out_default())
    # the row as one field, so that no name of ours meets one of the caller's
    judged = docs.select(F.struct(*docs.columns).alias("row"), predict(F.col("text")).alias("language")).where("language.lang_pred != 'und'")
    lang = F.coalesce("row.lang", "language.lang_pred").alias("lang")
    return judged.select(*[lang if c == "lang" else F.col("row").getField(c).alias(c) for c in docs.columns])


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents whose score is below the threshold; learns from the labels of the
    documents that came here."""
    score = quality.scorer(docs, table(spark, sf_dir, "labels"), ~quality.held_out_default())
    return docs.where(score(F.col("text")) >= quality.ACCEPT)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the least id stays, null ids last; of
    several texts of that id, one. Rows of one id and text count as one document, of which
    one row stays."""
    groups = cut(set_join.grouped_documents(docs).groupBy("doc_id", "text_key").agg(F.first("group").alias("group"), F.count("*").alias("rows")))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    first = groups.where(F.col("group").isNotNull()).groupBy("group").agg(F.min(order).alias("least"))
    first = first.select(F.col("least.doc_id").alias("id"), F.col("least.text_key").alias("key"))
    same = lambda id_, key: id_.eqNullSafe(F.col("id")) & (key == F.col("key"))
    gone = cut(groups.where(F.col("group").isNotNull()).join(first, same(groups["doc_id"], groups["text_key"]), "left_anti").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    here = same(F.col("row.doc_id"), set_join.text_key(F.col("row.text")))
    kept = rows.join(gone, here, "left_anti")
    repeated = cut(groups.where(F.col("rows") > 1).select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")))
    if not repeated.isEmpty():
        once = kept.join(repeated, here, "left_semi").groupBy(F.col("row.doc_id").alias("id"), F.col("row.text").alias("text")).agg(F.first("row").alias("row"))
        kept = kept.join(repeated, here, "left_anti").unionByName(once.select("row"))
    return kept.select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources uses it: up to three times, or not at all."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents, placed into sequences of 1024 ids; each use of a
    document is packed."""
    return packing.pack_documents(docs, BYTE_BPE, BYTE_RANKS)


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("ngram_jaccard_join", join_near_duplicates),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Learned models, sampled trees and tokenizers have no SQL form; tests hold the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
