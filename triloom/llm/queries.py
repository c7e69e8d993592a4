"""The queries of this package, their SQL, and the thin digests that the contracts ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join, media, mixing, pii, piece_sampling, pitman_yor, quality_cnn, suffix_dedup, token_counts, topk
from .common import read_table


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_features(read_table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(read_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(read_table(spark, sf_dir, "documents")).drop("k")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(read_table(spark, sf_dir, "documents"), token_counts.sample_edits())


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read_table(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read_table(spark, sf_dir, "documents"))


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.scores(read_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_cnn.score(docs, quality_cnn.fit(docs, read_table(spark, sf_dir, "labels")))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.encode(read_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": jaccard_join.SQL, "op3_suffix_dedup": suffix_dedup.SQL, "op6_topk": topk.SQL, "op7_mixing": mixing.SQL.replace("{docs}", "documents")}
