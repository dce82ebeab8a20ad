"""Sources: page snapshots, robots texts and link-check messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.operators.pages import NO_RESPONSE
from linkspark.schemas import LINK_JOB


def read_pages(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Page snapshot from Parquet. ``error`` says why a row has no html.

    With ``schema`` (as ``schemas.PAGE_SNAPSHOT``) the files are not asked for theirs.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    pages = reader.parquet(path)
    missing = F.col("html").isNull()
    known = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    return pages.withColumn("error", F.when(missing, F.coalesce(known, F.lit(NO_RESPONSE))).otherwise(known))


def read_robots(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Robots texts; only a text fetched with status 200 has rules, everything else allows all."""
    robots = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    return robots.filter("status = 200") if "status" in robots.columns else robots


def parse_link_jobs(messages: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good, rejected) of a batch or stream with JSON messages.

    ``good`` has one row per target. A message that is not valid JSON of the declared shape goes
    to ``rejected`` whole instead of failing the job.
    """
    shape = f"{LINK_JOB}, _corrupt string"
    parsed = messages.withColumn("_m", F.from_json(
        F.col(value).cast("string"), shape, {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_m").isNull() | F.col("_m._corrupt").isNotNull()
    rejected = parsed.filter(bad).drop("_m")
    good = parsed.filter(~bad).select(
        "_m.job_id", "_m.source_url", "_m.depth", F.posexplode_outer("_m.target_urls").alias("pos", "target_url"))
    return good.filter("target_url is not null").withColumn("pos", F.col("pos") + 1), rejected


def read_link_jobs(source: DataFrame) -> DataFrame:
    """Targets of a message stream or batch. The source itself (files, or Kafka where its package
    is on the class path) is the caller's ``spark.read`` or ``spark.readStream``."""
    return parse_link_jobs(source)[0]
