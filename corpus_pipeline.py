"""A training-data pipeline over ``documents``: each stage is one of the operators of ``linkspark.llm``.

A stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next one's docs;
all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import decontam, langid, minhash, packing, substring
from linkspark.session import scratch_dir, ship


def _labelled(docs: DataFrame) -> DataFrame:
    """The rows that language identification learns from: a label, and not held out."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return docs.filter(F.coalesce(rest != 0, F.lit(True))).select("text", "lang")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; ``lang`` is the one found. Texts without letters, and near ties
    between two languages, go."""
    told = langid.predict(docs, langid.train(_labelled(docs)))
    kept = told.filter((F.col("lang_pred") != langid.UNDETERMINED) & ~F.col("ambiguous"))
    return kept.withColumn("lang", F.col("lang_pred")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.one_of_each(docs).select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that are found elsewhere too; a text that loses all its words goes.

    What loses nothing stays as it is; what loses words is left as the others, joined by single spaces.
    """
    rest = substring.remove_repeats(docs).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return rest.withColumn("text", text).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, keep=False)  # the workers go on to other stages and runs


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("pack", pack_sequences),
]

# neither the classifier nor the tokenizer can be said in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written below the shared scratch folder."""
    ship(spark)
    folder = f"{scratch_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
