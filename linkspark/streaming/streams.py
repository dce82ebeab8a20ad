"""Structured Streaming forms of the batch operators. All times are event times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.functions import urls as U
from linkspark.operators import check as C
from linkspark.operators.metrics import rate, seconds
from linkspark.operators.skew import Agg, Step, scan
from linkspark.session import lookup_table
from linkspark.sources import sinks
from linkspark.sources.tables import parse_link_jobs


def dedupe_stream(urls: DataFrame, memory: str = "1 hour") -> DataFrame:
    """First sighting of every (job, URL); a URL is remembered for ``memory``."""
    keyed = urls.withColumn("url_hash", F.expr(U.canonical_hash("url")))
    return (keyed.filter("url_hash is not null").withWatermark("ts", memory)
            .dropDuplicatesWithinWatermark(["job_id", "url_hash"]))


def completions_stream(pages: DataFrame, idle: str = "30 seconds", late: str = "30 seconds") -> DataFrame:
    """A row per job when it has stored no page for ``idle``."""
    grouped = pages.withWatermark("crawled_at", late).groupBy("job_id", F.session_window("crawled_at", idle).alias("_s")).agg(
        F.count("*").alias("pages"))
    return grouped.select("job_id", F.col("_s.start").alias("started_at"),
                          F.col("_s.end").alias("completed_at"), "pages")


def _stretch(gap: int) -> Step:
    """The number of the stretch. A range takes its first row for a new one; where the range before it ends less than
    ``gap`` earlier it isn't, and all numbers from there on are one less."""
    fresh = F.col("_l__before").isNull() | (F.col("_t") - F.col("_l__before") > gap)
    joins = F.coalesce(F.col("_first") - F.col("_c__before") <= gap, F.lit(False)).cast("int")
    own = F.col("_t__nth") - joins
    return Step("_nth", lambda w: F.sum(fresh.cast("int")).over(w), F.max("_l__nth"),
                lambda w: F.coalesce(F.sum(own).over(w), F.lit(0)) - joins,
                F.col("_l__nth") + F.coalesce("_c__nth", F.lit(0)))


def job_sessions(pages: DataFrame, idle: str = "30 seconds") -> DataFrame:
    """Batch form of :func:`completions_stream`: stretches of activity per job.

    A page that comes more than ``idle`` after the one before it opens a stretch; the stretches are numbered in one
    scan that splits a job over many tasks, and counted before the shuffle.
    """
    at = F.unix_micros(F.col("crawled_at").cast("timestamp"))
    rows = pages.filter("crawled_at is not null").select(
        "job_id", "crawled_at", at.alias("_t"), F.monotonically_increasing_id().alias("_row"))
    order = ["_t", "_row"]
    rows = scan(rows, ["job_id"], order, [Agg("_before", "last", F.col("_t"), exclusive=True).step(order),
                                          _stretch(seconds(idle) * 1_000_000)], {"_first": F.min("_t")})
    return rows.groupBy("job_id", "_nth").agg(
        F.min("crawled_at").alias("started_at"), (F.max("crawled_at") + F.make_interval(secs=F.lit(seconds(idle)))).alias("completed_at"),
        F.count("*").alias("pages")).drop("_nth")


def rate_stream(events: DataFrame, window: str = "1 minute", slide: str = "15 seconds",
                by: tuple[str, ...] = (), late: str = "1 minute") -> DataFrame:
    return rate(events.withWatermark("ts", late), window, slide, by)


def counters_stream(pages: DataFrame) -> DataFrame:
    """Live counters per job (update mode)."""
    return pages.groupBy("job_id").agg(
        F.count("*").alias("total_pages_crawled"), F.sum("links_count").alias("total_links_found"))


def check_batch(messages: DataFrame, known: DataFrame) -> DataFrame:
    """Checked targets of a batch of link-check messages (``value``, ``ts``) against stored outcomes.

    Nothing is lost: a target that is no URL is broken with INVALID_URL, one that isn't in the log has a
    null ``is_valid``.
    """
    good, _ = parse_link_jobs(messages)
    targets = good.withColumn("canonical", F.expr(f"{U.canonical('target_url')}.canonical"))
    edges = targets.select("*", F.sha2("canonical", 256).alias("url_hash"),
                           F.lit("external").alias("category"),
                           F.lit(None).cast("string").alias("anchor_text"))
    return C.check_against(edges, known)


def broken_in(checked: DataFrame) -> DataFrame:
    return C.broken_links(checked, F.col("job_id"), F.col("depth"), F.current_timestamp())


def findings(messages: DataFrame, known: DataFrame) -> DataFrame:
    """What a stream of link-check messages brings to light, each once: rows with ``_kind`` (links, unseen, rejected).

    A link is known by job, source and target, a bad message by its text. What has been said before is remembered in
    the state of the stream, keyed, so a batch reads nothing but itself.
    """
    checked = check_batch(messages, known).filter(F.col("is_valid").isNull() | ~F.col("is_valid"))
    told = checked.select(
        F.when(F.col("is_valid").isNull(), "unseen").otherwise("links").alias("_kind"), "job_id", "source_url",
        F.coalesce("canonical", "target_url").alias("broken_url"), "anchor_text", "status_code", "error_type", "error_message",
        F.col("depth").cast("int").alias("depth"), F.current_timestamp().alias("discovered_at"), "target_url")
    told = told.withColumn("link_key", sinks.broken_link_key())
    bad = parse_link_jobs(messages)[1].select(F.lit("rejected").alias("_kind"), "value", F.sha2(F.col("value").cast("binary"), 256).alias("link_key"))
    return told.unionByName(bad, allowMissingColumns=True).dropDuplicates(["_kind", "link_key"])


def check_stream(messages: DataFrame, responses: DataFrame, out: str, checkpoint: str,
                 policy: str = "lenient"):
    """Start checking a message stream: broken links go to ``out/links``, targets that the log doesn't know to
    ``out/unseen``, bad messages to ``out/rejected``.

    The log is classified once, before the stream starts. Each batch overwrites its own folders, and links reported
    by earlier batches are known to the stream's state, so a batch that runs twice changes nothing.
    """
    known = lookup_table(C.outcomes(responses, policy))
    links = ["link_key", "job_id", "source_url", "broken_url", "anchor_text", "status_code", "error_type", "error_message", "depth",
             "discovered_at"]

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for kind, columns in (("links", links), ("unseen", ["job_id", "source_url", "depth", "target_url"]), ("rejected", ["value"])):
                sinks.append_batch(batch.filter(F.col("_kind") == kind).select(*columns), f"{out}/{kind}", batch_id)
        finally:
            batch.unpersist()

    return foreach_batch(findings(messages, known), handle, checkpoint)


def foreach_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    return (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
