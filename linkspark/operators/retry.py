"""Retries, backoff and dead letters over an attempt log.

A log row is one event of a task: ``STARTED``, ``SUCCESS`` or ``FAILURE``. Failures in a row
form an execution; a success, a failure that must not be retried, or a spent retry budget ends
it, and whatever the task does next starts a new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.operators.skew import Agg, Step, scan

MAX_RETRIES, BACKOFF_BASE, BACKOFF_MAX, JITTER = 5, 60, 600, 0.1

# Fixed value: exceptions that are never retried (bad input, programming error).
NEVER_RETRIED = ("ValueError", "TypeError")


def backoff_seconds(retry: Column, base: int = BACKOFF_BASE, cap: int = BACKOFF_MAX,
                    jitter_key: Column | None = None) -> Column:
    """``min(base * 2^retry, cap)`` in whole seconds.

    With ``jitter_key`` up to a tenth is added, drawn from a hash of the key: spread like random
    jitter, but the same again when a task is rerun.
    """
    delay = F.least(F.lit(base) * F.pow(F.lit(2.0), retry), F.lit(float(cap)))
    if jitter_key is not None:
        share = F.pmod(F.xxhash64(jitter_key, retry), F.lit(1_000_000)) / 1_000_000
        delay = delay + delay * JITTER * share
    return F.floor(delay).cast("int")


def with_backoff(df: DataFrame, base: int = BACKOFF_BASE, cap: int = BACKOFF_MAX,
                 jitter: bool = False, retry: str = "retry_number", key: str = "task_id") -> DataFrame:
    return df.withColumn("backoff_seconds", backoff_seconds(
        F.col(retry), base, cap, F.col(key) if jitter else None))


def retryable(attempts: DataFrame, honour_never_retried: bool = True) -> DataFrame:
    """Failures that may be tried again."""
    failed = attempts.filter(F.col("outcome") == "FAILURE")
    if not honour_never_retried:
        return failed
    return failed.filter(~F.coalesce(F.col("exception_class").isin(*NEVER_RETRIED), F.lit(False)))


def retry_decisions(attempts: DataFrame, max_retries: int = MAX_RETRIES, base: int = BACKOFF_BASE,
                    cap: int = BACKOFF_MAX, *, order: tuple[str, str] = ("ts", "seq"),
                    honour_never_retried: bool = True, jitter: bool = False) -> DataFrame:
    """Every finished attempt with ``retry_number`` (0 for a first run), ``decision`` and delay.

    ``decision`` is done, retry or dead_letter; the delay is set for retries only.
    """
    ts, seq = order
    never = F.lit(False)
    if honour_never_retried:
        never = F.coalesce(F.col("exception_class").isin(*NEVER_RETRIED), F.lit(False))
    rows = (attempts.filter(F.col("outcome").isin("SUCCESS", "FAILURE"))
            .withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
            .withColumn("_fatal", (F.col("outcome") == "FAILURE") & never))
    by = ["_t", seq]
    rows = scan(rows, ["task_id"], by, [Agg("_n", "count").step(by), _last_end()])
    place = F.col("_n") - F.coalesce("_end", F.lit(0)) - 1
    retry_number = F.pmod(place, F.lit(max_retries + 1)).cast("int")
    decision = (F.when(F.col("outcome") == "SUCCESS", "done")
                .when(F.col("_fatal") | (F.col("retry_number") >= max_retries), "dead_letter")
                .otherwise("retry"))
    delay = backoff_seconds(F.col("retry_number"), base, cap, F.col("task_id") if jitter else None)
    return (rows.withColumn("retry_number", retry_number).withColumn("decision", decision)
            .withColumn("backoff_seconds", F.when(F.col("decision") == "retry", delay))
            .select(*attempts.columns, "retry_number", "decision", "backoff_seconds"))


def _last_end() -> Step:
    """The place of the last attempt before this one that ended an execution; a range counts from its own start."""
    ends = F.when((F.col("outcome") == "SUCCESS") | F.col("_fatal"), F.col("_l__n"))
    before = F.coalesce("_c__n", F.lit(0))
    return Step("_end", lambda w: F.max(ends).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.max(ends),
                lambda w: F.max(F.col("_t__end") + before).over(w),
                F.coalesce(F.col("_l__end") + before, F.col("_c__end")))


def retry_history(decisions: DataFrame, ts: str = "ts") -> DataFrame:
    """One row per failed attempt that was tried again."""
    return decisions.filter("decision = 'retry'").select(
        "task_id", "retry_number", "exception_class", "exception_message", "backoff_seconds",
        F.col(ts).alias("retried_at"))


def dead_letters(decisions: DataFrame, ts: str = "ts") -> DataFrame:
    """One row per execution that failed for good, with its last exception."""
    return decisions.filter("decision = 'dead_letter'").select(
        "job_id", "task_id", "task_name", "exception_class", "exception_message",
        F.col("retry_number").alias("total_retries"), F.lit(False).alias("acknowledged"),
        F.col(ts).alias("final_failure_at"))


def task_status(attempts: DataFrame, decisions: DataFrame, *, order: tuple[str, str] = ("ts", "seq"),
                tasks: DataFrame | None = None) -> DataFrame:
    """Latest status per task; tasks of ``tasks`` without any event are PENDING."""
    status = F.when(F.col("decision") == "done", "SUCCESS").when(
        F.col("decision") == "retry", "RETRY").otherwise("FAILURE")
    seen = decisions.select("task_id", *order, status.alias("status")).unionByName(
        attempts.filter("outcome = 'STARTED'").select("task_id", *order, F.lit("STARTED").alias("status")))
    latest = seen.groupBy("task_id").agg(F.max_by("status", F.struct(*order)).alias("status"),
                                         F.max(order[0]).alias("updated_at"))
    if tasks is None:
        return latest
    return (tasks.select("task_id").distinct().join(latest, "task_id", "left")
            .withColumn("status", F.coalesce("status", F.lit("PENDING"))))


def dlq_backlog(letters: DataFrame) -> DataFrame:
    """Open dead letters per job and exception, the longest waiting first."""
    return (letters.filter("not acknowledged").groupBy("job_id", "exception_class")
            .agg(F.count("*").alias("open_letters"), F.min("final_failure_at").alias("oldest"))
            .orderBy("oldest", "job_id", "exception_class"))
