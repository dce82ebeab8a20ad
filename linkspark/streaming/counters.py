"""Live counters per job, kept up batch by batch.

Every batch of pages leaves one row per job it touches, under its number: a batch that comes again replaces its own
rows, so it counts once. A deletion of jobs is stored in the same way and takes back all that earlier batches have
counted for them. Reading merges the rows; compaction replaces those up to a batch by their sums, in a folder of its
own that counts only once it is complete, and what it has replaced is read no more.

    changes/batch_id=N      job_id, pages, links, gone
    base/upto=N             job_id, pages, links
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.streaming.streams import foreach_batch

CHANGE = "job_id string, pages bigint, links bigint, gone boolean"
BASE = "job_id string, pages bigint, links bigint"


def _files(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of the complete ``name=N`` folders below ``path``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return []
    found = []
    for status in system.listStatus(where):
        folder = status.getPath()
        if "=" in folder.getName() and system.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
            found.append((int(folder.getName().split("=", 1)[1]), folder.toString()))
    return sorted(found)


def changes(pages: DataFrame) -> DataFrame:
    """One row per job of a batch of ``pages(job_id, links_count)``; combined before the shuffle."""
    if "error" in pages.columns:
        pages = pages.filter("error is null")
    return pages.groupBy("job_id").agg(F.count("*").alias("pages"), F.coalesce(F.sum("links_count"), F.lit(0)).cast("bigint").alias("links"),
                                       F.lit(False).alias("gone"))


def _write(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/changes/batch_id={batch_id}")


def count_batch(pages: DataFrame, path: str, batch_id: int) -> None:
    """Count a batch; the same again if it comes twice."""
    _write(changes(pages), path, batch_id)


def forget_jobs(ids: DataFrame, path: str, batch_id: int) -> None:
    """Take back what the batches before ``batch_id`` have counted for these jobs; later batches count anew."""
    gone = ids.select(F.col("job_id").cast("string")).distinct()
    _write(gone.select("job_id", F.lit(0).cast("bigint").alias("pages"), F.lit(0).cast("bigint").alias("links"), F.lit(True).alias("gone")),
           path, batch_id)


def read_counters(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """(job_id, total_pages_crawled, total_links_found), after all batches, or those up to ``upto``."""
    bases = [(n, f) for n, f in _files(spark, f"{path}/base") if upto is None or n <= upto]
    start, base = bases[-1] if bases else (None, None)
    later = [(n, f) for n, f in _files(spark, f"{path}/changes") if (start is None or n > start) and (upto is None or n <= upto)]
    rows = spark.createDataFrame([], f"{CHANGE}, batch_id bigint")
    if later:
        read = spark.read.schema(f"{CHANGE}, batch_id bigint").option("basePath", f"{path}/changes").parquet(*[f for _, f in later])
        rows = rows.unionByName(read.select(*rows.columns))
    if base is not None:
        rows = rows.unionByName(spark.read.schema(BASE).parquet(base).withColumn("gone", F.lit(False)).withColumn(
            "batch_id", F.lit(start).cast("bigint")))
    # a job's last deletion is a column of the same grouping key: one shuffle of pre-aggregated rows, twice
    last = rows.filter("gone").groupBy(F.col("job_id").alias("_job")).agg(F.max("batch_id").alias("_gone_at"))
    kept = rows.join(last, F.col("job_id").eqNullSafe(F.col("_job")), "left").filter(
        ~F.col("gone") & (F.col("_gone_at").isNull() | (F.col("batch_id") > F.col("_gone_at"))))
    return kept.groupBy("job_id").agg(F.sum("pages").alias("total_pages_crawled"), F.sum("links").alias("total_links_found"))


def compact(spark: SparkSession, path: str, upto: int) -> None:
    """Sum up everything up to batch ``upto``; running it again writes the same.

    Not for a batch that may still come again: its rows are read no more.
    """
    own = read_counters(spark, path, upto)
    own.select("job_id", F.col("total_pages_crawled").alias("pages"), F.col("total_links_found").alias("links")).write.mode(
        "overwrite").parquet(f"{path}/base/upto={upto}")


def counting_stream(pages: DataFrame, path: str, checkpoint: str):
    """Start counting a stream of pages."""
    return foreach_batch(pages, lambda batch, batch_id: count_batch(batch, path, batch_id), checkpoint)
