"""The registered queries of the training-data operators, with SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from linkspark.llm import arc, colloc, decontam, fim, hmm, langid, minhash, packing, sharding, substring, tokenfile, urlfilter, vptree
from linkspark.llm.oracles import ORACLES as ORACLES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fold(n: int, id_column: str = "doc_id"):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % n


@query
def op1_minhash_dedup(spark, sf):
    return minhash.near_duplicates(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", "n_shingles", "component_id", "kept")


@query
def op2_language_id(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(fold(5) == 0, F.lit(False)))
    model = langid.train(docs.filter("not held_out").select("text", "lang"))
    return langid.predict(docs.drop("lang"), model).drop("text")


@query
def op3_decontaminate(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    judged = decontam.contamination(docs, table(spark, sf, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items",
                         F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


@query
def op4_hmm_lm(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", F.coalesce(fold(5) == 1, F.lit(False)))
    return hmm.score(docs, ~F.col("held_out"))


@query
def op5_vptree_ann(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return vptree.neighbours(rows, F.col("vec_id") % 20 == 0)


@query
def op6_substring_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_jump_shards(spark, sf):
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.shard_rows(rows, "doc_id").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        "grown_shard")


@query
def op8_simple8b_files(spark, sf):
    return tokenfile.through_files(table(spark, sf, "documents").select("doc_id", "text"), end_id=2)


@query
def op9_best_fit_packing(spark, sf):
    return packing.pack_documents(table(spark, sf, "documents").select("doc_id", "text"), end_id=0)


@query
def op10_arc_to_warc(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return arc.pages_through_archives(pages).drop("record_id")


URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/"))


@query
def op11_url_filter(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return urlfilter.judge_urls(pages, urlfilter.rules_of(spark, URL_RULES)).drop("url")


@query
def op12_collocations(spark, sf):
    return colloc.collocations(table(spark, sf, "documents").select("text", "lang"))


@query
def op13_fill_in_middle(spark, sf):
    return fim.fill_in_middle(table(spark, sf, "documents").select("doc_id", "text"))


@query
def pipeline(spark, sf):
    return corpus_pipeline.run(spark, sf)


if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
