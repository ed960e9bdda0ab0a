"""The registered queries of the training-data operators, and the SQL that restates them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import base, bpe, langid, media, minhash, packing, periods, quality, suffixes, tokenids, toxicity, turns, unigram, vectors

WORD_BPE, BYTE_BPE, PIECES = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(base.read_documents(spark, sf_dir))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.read_documents(spark, sf_dir)
    models = langid.fit(docs.where(~langid.held_out()))
    return langid.identify(docs, models).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed(base.read_documents(spark, sf_dir), suffixes.BYTES, suffixes.PASSAGES)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(base.read_documents(spark, sf_dir), public_tokenizers.path(PIECES))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(base.read_documents(spark, sf_dir))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.token_ids(base.read_documents(spark, sf_dir), public_tokenizers.path(WORD_BPE), end_id=1)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(base.read_documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), end_id=2, capacity=1024)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(base.read_documents(spark, sf_dir), public_tokenizers.path(WORD_BPE))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(base.read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = base.read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = langid.held_out(folds=3, fold=1)
    scored = toxicity.score(docs, toxicity.fit(docs, labels.where(~held)))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", "evidence")


def op11_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(turns.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.periodic_runs(base.read_documents(spark, sf_dir), plant=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_duplicates, op2_language, op3_repeats, op4_token_counts, op5_media, op6_token_ids, op7_packing, op8_bpe, op9_quality, op10_toxicity, op11_turns, op12_vectors, op13_periods)}


def oracle_sql() -> dict[str, str]:
    return {}
