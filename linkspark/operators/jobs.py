"""Job tables and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.functions import urls as U
from linkspark.operators.skew import Agg, running
from linkspark.schemas import TERMINAL_JOB_STATUSES
from linkspark.session import lookup_table

DEFAULT_DEPTH, DEFAULT_PAGES = 3, 100
MAX_DEPTH, MAX_PAGES = 10, 10_000
IDLE_SECONDS = 30
MAX_LIMIT = 1000


def intake_jobs(requests: DataFrame, created_at: Column) -> DataFrame:
    """Validated job rows; ``reject_reason`` is NULL for accepted ones (status PENDING).

    ``requests(request_id, url, max_depth, max_pages, respect_robots_txt)``; missing limits get
    their defaults. The job id is derived from the request, so a repeated request is the same job.
    """
    depth = F.coalesce("max_depth", F.lit(DEFAULT_DEPTH)).cast("int")
    pages = F.coalesce("max_pages", F.lit(DEFAULT_PAGES)).cast("int")
    reason = (F.when(F.expr(U.invalid_reason("url")).isNotNull(), "invalid_url")
              .when(~depth.between(1, MAX_DEPTH), "max_depth")
              .when(~pages.between(1, MAX_PAGES), "max_pages"))
    return requests.select(
        F.sha2(F.concat_ws("|", F.col("request_id").cast("string"), "url"), 256).alias("job_id"),
        "url", reason.alias("reject_reason"), depth.alias("max_depth"), pages.alias("max_pages"),
        F.coalesce("respect_robots_txt", F.lit(True)).alias("respect_robots_txt"),
        created_at.alias("created_at"),
    ).withColumn("status", F.when(F.col("reject_reason").isNull(), "PENDING"))


def job_state(events: DataFrame, seq: str = "seq") -> DataFrame:
    """Current state per job from ``job_events`` (``seq`` breaks ties of ``ts``)."""
    at = F.struct("ts", seq)
    status = F.col("status")
    has_error = F.when(F.col("error_message") != "", at)
    return events.groupBy("job_id").agg(
        F.max_by("status", at).alias("status"),
        F.min(F.when(status == "IN_PROGRESS", F.col("ts"))).alias("started_at"),
        F.max(F.when(status.isin(*TERMINAL_JOB_STATUSES), F.col("ts"))).alias("completed_at"),
        F.max_by("error_message", has_error).alias("error_message"))


def apply_cancels(events: DataFrame, seq: str = "seq") -> DataFrame:
    """Cancel events with ``decision``: rejected when the job has ended before.

    A cancel leaves the job ended whether it is accepted or not, so the state before an event is
    ended exactly when the previous event names a terminal status.
    """
    rows = events.withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp")))
    rows = running(rows, ["job_id"], ["_t", seq],
                   [Agg("previous_status", "last", F.col("status"), exclusive=True)])
    ended = F.coalesce(F.col("previous_status").isin(*TERMINAL_JOB_STATUSES), F.lit(False))
    return (rows.filter("status = 'CANCELLED'")
            .withColumn("decision", F.when(ended, "rejected").otherwise("accepted"))
            .select(*events.columns, "previous_status", "decision"))


def idle_jobs(jobs: DataFrame, pages: DataFrame, at: Column, idle: int = IDLE_SECONDS) -> DataFrame:
    """IN_PROGRESS jobs that are done (no page for ``idle`` seconds) or stalled (no page ever)."""
    last = pages.groupBy("job_id").agg(F.max("crawled_at").alias("last_page_at"))
    quiet = F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.col("last_page_at").cast("timestamp"))
    return (jobs.filter("status = 'IN_PROGRESS'").select("job_id").join(last, "job_id", "left")
            .withColumn("verdict", F.when(F.col("last_page_at").isNull(), "stalled")
                        .when(quiet >= idle * 1_000_000, "completed").otherwise("active"))
            .filter("verdict != 'active'"))


def age_text(ts: Column, at: Column) -> Column:
    seconds = F.unix_seconds(at.cast("timestamp")) - F.unix_seconds(ts.cast("timestamp"))
    text = F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d ago"))
    for size, below, unit in ((3600, 86400, "h"), (60, 3600, "m"), (1, 60, "s")):
        text = F.when(seconds < below, F.concat(
            F.floor(seconds / size).cast("string"), F.lit(f"{unit} ago"))).otherwise(text)
    return text


def page_of(rows: DataFrame, newest: str, tie: str, skip: int, limit: int) -> DataFrame:
    """Newest first, ``limit`` rows after ``skip``, with the ``total`` before paging and how many are ``returned``.

    A deep ``skip`` makes the top-n as deep; :func:`page_after` goes on from the last row seen instead.

    The total is a scalar subquery, so the rows themselves only go through a top-n.
    """
    if not 1 <= limit <= MAX_LIMIT or skip < 0:
        raise ValueError(f"limit must be 1..{MAX_LIMIT} and skip not negative")
    total = rows.agg(F.count("*").alias("total")).scalar()
    return (rows.orderBy(F.desc(newest), F.asc(tie)).offset(skip).limit(limit)
            .withColumn("total", total)
            .withColumn("returned", F.greatest(F.least(F.lit(limit).cast("bigint"), F.col("total") - skip), F.lit(0).cast("bigint"))))


def page_after(rows: DataFrame, newest: str, tie: str, last: tuple | None, limit: int) -> DataFrame:
    """The next ``limit`` rows after the row with ``last = (newest, tie)``: a filter and a top-n, however deep."""
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be 1..{MAX_LIMIT}")
    if last is not None:
        at, key = F.lit(last[0]), F.lit(last[1])
        rows = rows.filter((F.col(newest) < at) | ((F.col(newest) == at) & (F.col(tie) > key)))
    return rows.orderBy(F.desc(newest), F.asc(tie)).limit(limit)


def list_jobs(jobs: DataFrame, at: Column, status: str | None = None, user_id: str | None = None,
              skip: int = 0, limit: int = 100) -> DataFrame:
    if status is not None:
        jobs = jobs.filter(F.col("status") == status)
    if user_id is not None:
        jobs = jobs.filter(F.col("user_id") == user_id)
    return page_of(jobs, "created_at", "job_id", skip, limit).withColumn(
        "age", age_text(F.col("created_at"), at))


def broken_links_page(broken: DataFrame, job_id: str, skip: int = 0, limit: int = 100) -> DataFrame:
    return page_of(broken.filter(F.col("job_id") == job_id), "discovered_at", "broken_url", skip, limit)


def pages_by_job(pages: DataFrame, job_id: str, skip: int = 0, limit: int = 100) -> DataFrame:
    return page_of(pages.filter(F.col("job_id") == job_id), "crawled_at", "url", skip, limit)


def job_counters(pages: DataFrame, broken: DataFrame) -> DataFrame:
    """Pages crawled, links found and broken links per job, counted from the tables.

    ``pages`` may carry ``error``; pages with one are stored but not counted.
    """
    if "error" in pages.columns:
        pages = pages.filter("error is null")
    crawled = pages.groupBy("job_id").agg(
        F.count("*").alias("total_pages_crawled"),
        F.coalesce(F.sum("links_count"), F.lit(0)).alias("total_links_found"))
    bad = broken.groupBy("job_id").agg(F.count("*").alias("total_broken_links"))
    zero = F.lit(0).cast("long")
    return crawled.join(bad, "job_id", "full").select(
        "job_id", *[F.coalesce(c, zero).alias(c) for c in (
            "total_pages_crawled", "total_links_found", "total_broken_links")])


def link_totals(edges: DataFrame) -> DataFrame:
    """Links per job told apart: found, external, and distinct targets that were checked.

    ``edges(job_id, category, url_hash)``. Targets are made distinct by grouping on (job, target)
    first, so a job with a third of all links is not gathered in one task.
    """
    outside = F.col("category") == "external"
    per_target = edges.groupBy("job_id", F.when(outside, F.col("url_hash")).alias("_target")).agg(
        F.count("*").alias("_n"))
    known = F.col("_target").isNotNull()
    return per_target.groupBy("job_id").agg(
        F.sum("_n").alias("links_kept"),
        F.coalesce(F.sum(F.when(known, F.col("_n"))), F.lit(0)).alias("external_links"),
        F.count_if(known).alias("checked_targets"))


def job_summary(jobs: DataFrame, pages: DataFrame, broken: DataFrame, at: Column, edges: DataFrame | None = None) -> DataFrame:
    """Per job: statistics, timestamps, error, elapsed time and progress.

    With ``edges`` the statistics also tell links kept, external links and distinct targets checked.
    """
    counters, extra = job_counters(pages, broken), ["links_kept", "external_links", "checked_targets"] if edges is not None else []
    if edges is not None:
        counters = counters.join(link_totals(edges), "job_id", "full")
    end = F.coalesce(F.col("completed_at"), at.cast("timestamp"))
    elapsed = F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp"))
    minutes = F.floor(elapsed / 60)
    zero = F.lit(0).cast("long")
    rows = jobs.join(counters, "job_id", "left").withColumn("_elapsed", elapsed)
    crawled = F.coalesce("total_pages_crawled", zero)
    return rows.select(
        "job_id", "url", "status",
        F.struct(crawled.alias("pages_crawled"), F.coalesce("total_links_found", zero).alias("links_found"),
                 F.coalesce("total_broken_links", zero).alias("broken_links"),
                 *[F.coalesce(c, zero).alias(c) for c in extra], "max_depth", "max_pages").alias("statistics"),
        F.struct("created_at", "started_at", "completed_at").alias("timestamps"),
        F.col("error_message").alias("error"),
        F.col("_elapsed").alias("elapsed_seconds"),
        F.when(F.col("_elapsed") < 60, F.concat(F.col("_elapsed").cast("string"), F.lit("s"))).otherwise(
            F.concat(minutes.cast("string"), F.lit("m "), (F.col("_elapsed") - minutes * 60).cast("string"),
                     F.lit("s"))).alias("elapsed"),
        F.least(F.lit(100.0), crawled / F.col("max_pages") * 100).alias("progress"))


def is_visited(urls: DataFrame, pages: DataFrame, col: str = "url") -> DataFrame:
    """Add ``visited``: has this job stored a page with the same canonical URL."""
    known = lookup_table(pages.select("job_id", F.col("url_hash").alias("_hash")).distinct()).withColumn(
        "_hit", F.lit(True))
    rows = urls.withColumn("_hash", F.expr(U.canonical_hash(col)))
    return (rows.join(known, ["job_id", "_hash"], "left")
            .withColumn("visited", F.coalesce("_hit", F.lit(False))).drop("_hash", "_hit"))


def delete_jobs(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Tables without the jobs in ``ids``: pages and broken links go too, dead letters lose the job id."""
    gone = lookup_table(ids.select("job_id").distinct())
    kept = {}
    for name, table in tables.items():
        if name == "dead_letters":
            marked = table.join(gone.withColumn("_gone", F.lit(True)), "job_id", "left")
            kept[name] = marked.withColumn("job_id", F.when(F.col("_gone").isNull(), F.col("job_id"))).select(
                *table.columns)
        else:
            kept[name] = table.join(gone, "job_id", "left_anti")
    return kept
