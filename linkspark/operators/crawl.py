"""Breadth-first crawl of many jobs at once over a page snapshot.

One round per depth. The order inside a depth is (order of the parent, place of the link on the
parent), kept as one number per attempt, so every gate has one answer however the rows are
partitioned. Each round is written to the scratch folder: plans stay short, and a lost executor
costs a task, not the crawl.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.functions import urls as U
from linkspark.operators import robots as R
from linkspark.operators.links import MAX_CHILD_LINKS
from linkspark.operators.skew import Agg, running
from linkspark.session import cut, scratch_dir

ORD = "decimal(38,0)"  # (links + 1) ^ depth outgrows a long at the deepest allowed crawl
VISITED = ("success", "error", "robots_denied")


def crawl_site(linked: DataFrame, order: str = "page_id", max_links: int = MAX_CHILD_LINKS) -> DataFrame:
    """Snapshot keyed by canonical URL: is there a page, and which links may be followed.

    ``linked`` is :func:`page_links` output with ``links_count`` and optional ``status_code`` and
    ``error``. When two rows share a canonical URL the first by ``order`` is the page.
    """
    error = F.col("error") if "error" in linked.columns else F.lit(None).cast("string")
    status = F.col("status_code") if "status_code" in linked.columns else F.lit(None).cast("int")
    inside = F.filter("links", lambda l: (l["category"] == "internal") & (l["rank"] <= max_links))
    follow = F.transform(inside, lambda l: F.struct(
        l["url_hash"].alias("url_hash"), l["canonical"].alias("url"), l["rank"].alias("rank")))
    page = F.struct(error.isNull().alias("fetched"), status.cast("int").alias("status_code"),
                    F.when(error.isNull(), F.col("links_count")).otherwise(0).alias("links_count"),
                    F.when(error.isNull(), follow).alias("links"))
    rows = linked.select(F.expr(U.canonical_hash("url")).alias("url_hash"),
                         page.alias("_page"), F.col(order).alias("_order"))
    return rows.groupBy("url_hash").agg(F.min_by("_page", "_order").alias("_p")).select("url_hash", "_p.*")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def crawl(jobs: DataFrame, site: DataFrame, groups: DataFrame | None = None,
          agent: str = R.DEFAULT_AGENT, max_links: int = MAX_CHILD_LINKS) -> DataFrame:
    """One row per (job, URL, depth) that was attempted, with the outcome of its first attempt.

    ``jobs(job_id, url, max_depth, max_pages, respect_robots_txt, status)``. ``repeats`` counts
    further attempts that found the URL visited, ``late`` those after the page budget was spent.
    Pages without an error count against the budget; robots-denied URLs are visited, not stored.
    """
    site = cut(site)
    if groups is not None:
        groups = cut(groups)
    flags = site.select("url_hash", "fetched", "status_code", "links_count")
    seeds = cut(jobs.withColumn("url", F.expr(f"{U.canonical('url')}.canonical")))
    live = seeds.filter("status != 'CANCELLED' and url is not null")
    deepest = live.agg(F.max("max_depth")).first()[0]
    attempts = live.select("job_id", "url", F.sha2("url", 256).alias("url_hash"),
                           F.lit(0).cast(ORD).alias("ord"), F.lit(None).cast("string").alias("parent_url"))
    levels: list[DataFrame] = []
    # what later rounds need of earlier ones: one narrow table of visited keys, added to round by round and read once
    # in each, and a count per job; the levels themselves are read at the end only
    visited, used = _Visited(site.sparkSession), None
    for depth in range(0 if deepest is None else deepest + 1):
        found = cut(_judge(attempts, visited, flags, live, groups, agent))
        budget = found.groupBy("job_id").agg(F.count_if("ok").alias("_n")).join(
            live.select("job_id", "max_pages"), "job_id")
        if used is not None:
            budget = budget.join(used, "job_id", "left")
        else:
            budget = budget.withColumn("_used", F.lit(0))
        budget = budget.withColumn("_left", F.greatest(
            F.col("max_pages") - F.coalesce("_used", F.lit(0)), F.lit(0)))
        active, spent = budget.agg(F.count("*"), F.count_if(F.col("_n") >= F.col("_left"))).first()
        if not active:
            break
        if spent:
            over = budget.filter("_n >= _left").select("job_id", "_left")
            level = cut(_outcome(_spend(found, attempts, over), depth))
        else:
            level = _outcome(found.withColumn("_stop", F.lit(None).cast(ORD))
                             .withColumn("late", F.lit(0).cast("long")), depth)
        levels.append(level)
        if depth == deepest:
            break
        visited.add(level)
        spent_now = level.filter("outcome = 'success'").groupBy("job_id").agg(F.count("*").alias("_used"))
        used = cut(spent_now if used is None else used.unionByName(spent_now).groupBy("job_id").agg(F.sum("_used").alias("_used")))
        open_jobs = live.filter(F.col("max_depth") > depth).select("job_id")
        attempts = (level.filter("outcome = 'success'").join(open_jobs, "job_id")
                    .join(site.select("url_hash", "links"), "url_hash")
                    .select("job_id", F.col("url").alias("parent_url"), "ord", F.explode("links").alias("_l"))
                    .select("job_id", "_l.url", "_l.url_hash",
                            (F.col("ord") * (max_links + 1) + F.col("_l.rank")).cast(ORD).alias("ord"),
                            "parent_url"))
    refused = seeds.filter("status = 'CANCELLED' or url is null").select(
        "job_id", "url", F.sha2("url", 256).alias("url_hash"), F.lit(0).alias("depth"),
        F.lit(0).cast(ORD).alias("ord"), F.lit(None).cast("string").alias("parent_url"),
        F.when(F.col("status") == "CANCELLED", "cancelled").otherwise("invalid_url").alias("outcome"),
        F.lit(0).cast("long").alias("repeats"), F.lit(0).cast("long").alias("late"),
        F.lit(None).cast("int").alias("status_code"), F.lit(0).alias("links_count"))
    return _union([*levels, refused])


class _Visited:
    """(job_id, url_hash) of all rounds so far, in one folder. Joins with it are narrowed by Spark's own runtime filters."""

    def __init__(self, spark) -> None:
        self.spark, self.path, self.schema = spark, f"{scratch_dir(spark).rstrip('/')}/linkspark/{uuid.uuid4().hex}", None

    def add(self, level: DataFrame) -> None:
        own = level.filter(F.col("outcome").isin(*VISITED)).select("job_id", "url_hash")
        own.write.mode("append").parquet(self.path)
        self.schema = own.schema

    def read(self) -> DataFrame | None:
        return None if self.schema is None else self.spark.read.schema(self.schema).parquet(self.path)


def _judge(attempts: DataFrame, visited: _Visited, flags: DataFrame, live: DataFrame,
           groups: DataFrame | None, agent: str) -> DataFrame:
    """First attempt per (job, URL) with everything the gates need to know."""
    rows = (attempts.groupBy("job_id", "url_hash")
            .agg(F.min(F.struct("ord", "url", "parent_url")).alias("_f"), F.count("*").alias("attempts"))
            .select("job_id", "url_hash", "_f.*", "attempts"))
    known = visited.read()
    if known is not None:
        rows = rows.join(known.withColumn("seen", F.lit(True)), ["job_id", "url_hash"], "left")
    else:
        rows = rows.withColumn("seen", F.lit(None).cast("boolean"))
    rows = rows.withColumn("seen", F.coalesce("seen", F.lit(False))).join(flags, "url_hash", "left")
    denied = F.lit(False)
    if groups is not None:
        rows = R.robots_allowed(rows, groups, agent).join(
            live.select("job_id", "respect_robots_txt"), "job_id")
        denied = F.col("respect_robots_txt") & ~F.col("allowed")
    rows = rows.withColumn("denied", denied).withColumn("fetched", F.coalesce("fetched", F.lit(False)))
    return rows.withColumn("ok", ~F.col("seen") & ~F.col("denied") & F.col("fetched")).drop(
        "allowed", "respect_robots_txt")


def _spend(found: DataFrame, attempts: DataFrame, over: DataFrame) -> DataFrame:
    """Where the budget of each job in ``over`` ends: attempts ordered after ``_stop`` are late."""
    counted = running(found.filter("ok").join(over, "job_id"), ["job_id"], ["ord"],
                      [Agg("_place", "count")])
    stops = cut(counted.filter("_place = _left").select("job_id", F.col("ord").alias("_stop")).unionByName(
        over.filter("_left = 0").select("job_id", F.lit(-1).cast(ORD).alias("_stop"))))
    late = (attempts.join(stops, "job_id").filter(F.col("ord") > F.col("_stop"))
            .groupBy("job_id", "url_hash").agg(F.count("*").alias("late")))
    return (found.join(stops, "job_id", "left").join(late, ["job_id", "url_hash"], "left")
            .withColumn("late", F.coalesce("late", F.lit(0))))


def _outcome(rows: DataFrame, depth: int) -> DataFrame:
    too_late = F.coalesce(F.col("ord") > F.col("_stop"), F.lit(False))
    outcome = (F.when(too_late, "max_pages_reached").when(F.col("seen"), "already_visited")
               .when(F.col("denied"), "robots_denied").when(F.col("fetched"), "success").otherwise("error"))
    return rows.select(
        "job_id", "url", "url_hash", F.lit(depth).alias("depth"), "ord", "parent_url",
        outcome.alias("outcome"),
        (F.col("attempts") - F.col("late") - (~too_late).cast("int")).alias("repeats"),
        (F.col("late") - too_late.cast("int")).alias("late"),
        "status_code", F.coalesce("links_count", F.lit(0)).alias("links_count"))


def crawled_urls(result: DataFrame) -> DataFrame:
    """Stored pages of a crawl: fetched or failed, with depth and the page that led to them."""
    return result.filter(F.col("outcome").isin("success", "error")).select(
        "job_id", "url", "url_hash", "depth", "parent_url", "outcome", "status_code", "links_count")


def crawl_outcomes(result: DataFrame, *by: str) -> DataFrame:
    """Attempts per outcome, repeated attempts included."""
    parts = F.inline(F.array(
        F.struct(F.col("outcome").alias("outcome"), F.lit(1).cast("long").alias("n")),
        F.struct(F.lit("already_visited").alias("outcome"), F.col("repeats").alias("n")),
        F.struct(F.lit("max_pages_reached").alias("outcome"), F.col("late").alias("n"))))
    return (result.select(*by, parts).filter("n > 0")
            .groupBy(*by, "outcome").agg(F.sum("n").alias("attempts")))
