"""The queries opN_<name> that apply the training-data operators to the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm import bpe, infill, language_id, mixing, oracle, packing, periodic, quality, set_join, token_counts, toxicity, url_filter, vectors
from linewright.llm.common import table

RULES: list[url_filter.Rule] = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: The vocabulary files are parameters of the operators; the queries use these.
BYTE_BPE, BYTE_RANKS, WORD_BPE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), BYTE_BPE, BYTE_RANKS)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), WORD_BPE, limit=2048)


def op8_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.similar_documents(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = periodic.planted(F.col("doc_id"), F.col("text"))
    return periodic.digests(periodic.periodic_runs(docs.select("doc_id", text.alias("text"))))


def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(bpe.encode(docs, BYTE_BPE, bpe.compile_lexicon(docs, BYTE_BPE)), BYTE_BPE)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(infill.transform(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_embedding_dedup, op3_packing, op4_language_id, op5_top_k, op6_toxicity, op7_token_counts, op8_set_join, op9_mixing, op10_url_filter, op11_periodic_runs, op12_bpe_codec, op13_fill_in_middle)}

ORACLE_SQL: dict[str, str] = {
    "op2_embedding_dedup": oracle.NEAR_VECTORS,
    "op5_top_k": oracle.TOP_K,
    "op8_set_join": oracle.NEAR_DOCUMENTS,
    "op9_mixing": oracle.MIX,
    "op10_url_filter": oracle.url_verdicts(RULES),
    "op11_periodic_runs": oracle.PERIODIC_RUNS,
    "op13_fill_in_middle": oracle.FILL_IN_MIDDLE,
}
