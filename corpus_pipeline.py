"""The corpus pipeline: from ``documents`` to packed sequences.

Each stage takes (spark, docs, sf_dir) and what the stage before it kept; :func:`run` writes each stage's result as Parquet
to the shared folder and reads it back. All stages but the last return the columns of ``documents``.

Defined results: a null or empty text has no letter and goes in the second stage; long texts are taken whole; rows of one id and
different texts are rows of their own; of equal rows, and of copies whatever their ids, one stays; a row without an id stays
unless a copy has one; an empty table gives an empty table at every stage; further columns pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort_audit.llm import base, langid, minhash, packing, suffixes, toxicity


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: rows predicted toxic go. The labelled rows outside the held-out fold are learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~langid.held_out(folds=3, fold=1))
    return toxicity.clean(docs, toxicity.fit(docs, labels))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: rows without a letter, or too far from every learned language, go."""
    base.give_back()  # what the stage before has freed in the driver
    base.swept(spark)  # and on the disk
    return langid.known(docs, langid.fit(docs.where(~langid.held_out())))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each class of near duplicates one row stays, that of the least id (rows without an id come last).

    Rows of one id and different texts, and rows without an id, are known by the hash of id and text, beyond other ids: an id
    with two unlike texts keeps both. Of equal rows one stays.
    """
    base.give_back()  # what the stage before has freed in the driver
    base.swept(spark)  # and on the disk
    # Each row travels as one struct, so columns of any name clash with nothing.
    key = F.lit(1 << 62).bitwiseOR(F.xxhash64("id", "text").bitwiseAND(F.lit((1 << 62) - 1)))
    rows = docs.select(base.whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    often = minhash.repeated_ids(rows.select(F.col("id").alias("doc_id"))).select(F.col("doc_id").alias("id"), F.lit(True).alias("often"))
    rows = rows.join(F.broadcast(often) if often.count() < 10_000 else often, "id", "left")
    rows = rows.withColumn("key", F.when(F.col("id").isNull() | F.col("often").isNotNull(), key).otherwise(F.col("id"))).drop("often")
    classes = base.stored(minhash.near_duplicates(rows.select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "class_id"), "classes")
    ids = rows.select("key", "id").distinct()
    order = F.struct(F.col("id").isNull(), "id", "key")
    best = classes.distinct().join(ids, "key").groupBy("class_id").agg(F.min_by("key", order).alias("key")).select("key")
    rows = rows.select("key", "row").join(best, "key", "left_semi")
    twice = minhash.repeated_ids(classes.select(F.col("key").alias("doc_id"))).withColumnRenamed("doc_id", "key")
    if not twice.isEmpty():
        one = rows.join(twice, "key", "left_semi").groupBy("key").agg(F.first("row").alias("row"))
        rows = rows.join(twice, "key", "left_anti").select("row").union(one.select("row"))
    return rows.select("row.*")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: passages of over 50 words that repeat are cut out; ``n_chars`` follows the text.

    In bytes such passages are of any length (the 400 bytes of the operator's own query miss most), so words are counted.
    """
    base.give_back()  # what the stage before has freed in the driver
    base.swept(spark)  # and on the disk
    cut = suffixes.without_repeats(docs, suffixes.PASSAGES)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: pieces of the documents and their places in sequences of 1024 tokens."""
    base.give_back()  # what the stage before has freed in the driver
    base.swept(spark)  # and on the disk
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("toxicity", not_toxic),
    ("language", known_language),
    ("near_duplicates", one_of_near_duplicates),
    ("repeats", without_repeats),
    ("packing", packed),
]

#: SQL expresses none of the stages; tests hold each against a brute-force version or held-out labels instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = base.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
