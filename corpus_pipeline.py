"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm import bpe, decontaminate, jaccard, substring, toxicity
from lantern.llm._storage import light, materialise, purge, small_batches, written
from lantern.llm.queries import CATEGORIES, table, vocabulary

#: Chunks whose tokens a worker keeps: beside the other stages there is less room than for the encoder alone.
KEPT_CHUNKS = 120_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, fitted on the labelled ones among them, doesn't call toxic."""
    small_batches(spark)
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    return toxicity.keep(docs, chain)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id. Rows that repeat an id share its fate."""
    small_batches(spark)
    groups = jaccard.similar_documents(docs).filter(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias("_gone")).distinct()
    gone = light(materialise(groups, "gone"), 1_000_000)
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that stand in an earlier document are cut from the texts."""
    small_batches(spark)
    cut = substring.remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    small_batches(spark)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document left."""
    small_batches(spark)
    return bpe.encode_digests(docs, vocabulary("word_bpe_49k.json"), most=KEPT_CHUNKS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("bpe", tokenise),
]

#: The toxicity model and the tokenizer can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next.

    What a stage wrote for itself is deleted when its result stands; tables of other queries stay.
    """
    others = written()
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        purge(spark, keep=[*others, written()[-1]])
    return STAGES[-1][1](spark, docs, sf_dir)
