"""Retries, dead letters, job tables and reports."""
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from linkspark.operators import jobs as J
from linkspark.operators import retry as R
from linkspark.schemas import BROKEN_LINKS

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_backoff(spark):
    df = spark.createDataFrame([(0, 60), (1, 120), (2, 240), (3, 480), (4, 600), (10, 600), (40, 600)], "retry_number int, want int")
    assert all(r.backoff_seconds == r.want for r in R.with_backoff(df).collect())
    small = spark.createDataFrame([(0,)], "retry_number int")
    assert R.with_backoff(small, 10, 100).first().backoff_seconds == 10
    many = spark.range(500).selectExpr("cast(id as string) as task_id", "0 as retry_number")
    delays = [r.backoff_seconds for r in R.with_backoff(many, jitter=True).collect()]
    assert min(delays) >= 60 and max(delays) <= 66 and len(set(delays)) > 3
    assert delays == [r.backoff_seconds for r in R.with_backoff(many.repartition(3), jitter=True).orderBy(
        F.col("task_id").cast("int")).collect()]


def _attempts(seed, n=400):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        task = "hot" if rnd.random() < 0.5 else f"t{rnd.randrange(8)}"
        outcome = rnd.choices(["FAILURE", "SUCCESS", "STARTED"], [8, 1, 2])[0]
        kind = rnd.choices(["TimeoutError", "ValueError"], [9, 1])[0] if outcome == "FAILURE" else None
        rows.append((task, "job", "crawl", at(i // 3), i, outcome, kind, kind))
    return rows


def _decide(rows, max_retries, honour):
    count, out = {}, {}
    for task, _, _, _, i, outcome, kind, _ in rows:
        if outcome == "STARTED":
            continue
        n = count.get(task, 0)
        if outcome == "SUCCESS":
            out[i], count[task] = (n, "done"), 0
        elif (honour and kind == "ValueError") or n >= max_retries:
            out[i], count[task] = (n, "dead_letter"), 0
        else:
            out[i], count[task] = (n, "retry"), n + 1
    return out


SCHEMA = ("task_id string, job_id string, task_name string, ts timestamp, seq long, outcome string, "
          "exception_class string, exception_message string")


@pytest.mark.parametrize("max_retries,honour", [(5, True), (2, True), (5, False)])
def test_decisions(spark, max_retries, honour):
    rows = _attempts(max_retries)
    shuffled = random.Random(1).sample(rows, len(rows))
    out = R.retry_decisions(spark.createDataFrame(shuffled, SCHEMA), max_retries, honour_never_retried=honour).collect()
    want = _decide(rows, max_retries, honour)
    assert {r.seq: (r.retry_number, r.decision) for r in out} == want
    assert all((r.backoff_seconds is not None) == (r.decision == "retry") for r in out)


def test_history_letters_status(spark):
    rows = [("a", "j", "crawl", at(i), i, "FAILURE", "TimeoutError", f"m{i}") for i in range(6)]
    rows += [("b", "j", "crawl", at(0), 10, "FAILURE", "ValueError", "bad"), ("c", "j", "crawl", at(0), 11, "SUCCESS", None, None),
             ("d", "j", "crawl", at(0), 12, "STARTED", None, None), ("e", "j", "crawl", at(0), 13, "FAILURE", "OSError", "x")]
    attempts = spark.createDataFrame(rows, SCHEMA)
    decisions = R.retry_decisions(attempts)
    history = R.retry_history(decisions).filter("task_id = 'a'").orderBy("retry_number").collect()
    assert [(r.retry_number, r.backoff_seconds) for r in history] == [(0, 60), (1, 120), (2, 240), (3, 480), (4, 600)]
    letters = {r.task_id: r for r in R.dead_letters(decisions).collect()}
    assert (letters["a"].total_retries, letters["a"].exception_message, letters["a"].final_failure_at) == (5, "m5", at(5))
    assert letters["b"].total_retries == 0 and letters.keys() == {"a", "b"}
    tasks = spark.createDataFrame([(t,) for t in "abcdef"], "task_id string")
    status = {r.task_id: r.status for r in R.task_status(attempts, decisions, tasks=tasks).collect()}
    assert status == {"a": "FAILURE", "b": "FAILURE", "c": "SUCCESS", "d": "STARTED", "e": "RETRY", "f": "PENDING"}
    assert {r.task_id for r in R.retryable(attempts).collect()} == {"a", "e"}
    assert {r.task_id for r in R.retryable(attempts, False).collect()} == {"a", "b", "e"}
    backlog = R.dlq_backlog(R.dead_letters(decisions)).collect()
    assert [(r.exception_class, r.open_letters) for r in backlog] == [("ValueError", 1), ("TimeoutError", 1)]


def test_intake(spark):
    rows = [(1, "https://a.com", None, None, None), (2, "nope", 3, 5, True), (3, "http://a.com", 0, 5, True),
            (4, "http://a.com", 11, 5, True), (5, "http://a.com", 10, 10000, False), (6, "http://a.com", 1, 10001, True)]
    df = spark.createDataFrame(rows, "request_id int, url string, max_depth int, max_pages int, respect_robots_txt boolean")
    out = J.intake_jobs(df, F.lit(T0)).collect()
    assert [r.reject_reason for r in out] == [None, "invalid_url", "max_depth", "max_depth", None, "max_pages"]
    assert (out[0].max_depth, out[0].max_pages, out[0].respect_robots_txt, out[0].status) == (3, 100, True, "PENDING")
    assert out[1].status is None and len({r.job_id for r in out}) == 6


EVENTS = [("a", 0, "PENDING", None), ("a", 1, "IN_PROGRESS", None), ("a", 2, "IN_PROGRESS", None), ("a", 3, "CANCELLED", None),
          ("a", 4, "CANCELLED", None), ("b", 0, "IN_PROGRESS", None), ("b", 1, "FAILED", "boom"), ("b", 2, "CANCELLED", ""),
          ("b", 3, "IN_PROGRESS", None), ("b", 4, "CANCELLED", None), ("c", 0, "PENDING", None)]


def test_states_and_cancels(spark):
    df = spark.createDataFrame([(j, at(t), i, s, e) for i, (j, t, s, e) in enumerate(EVENTS)],
                               "job_id string, ts timestamp, seq long, status string, error_message string")
    state = {r.job_id: r for r in J.job_state(df).collect()}
    assert (state["a"].status, state["a"].started_at, state["a"].completed_at) == ("CANCELLED", at(1), at(4))
    assert (state["b"].status, state["b"].error_message, state["b"].started_at) == ("CANCELLED", "boom", at(0))
    assert (state["c"].status, state["c"].started_at, state["c"].completed_at) == ("PENDING", None, None)
    cancels = {(r.job_id, r.ts): r.decision for r in J.apply_cancels(df).collect()}
    assert cancels == {("a", at(3)): "accepted", ("a", at(4)): "rejected", ("b", at(2)): "rejected", ("b", at(4)): "accepted"}


def test_idle(spark):
    jobs = spark.createDataFrame([("old", "IN_PROGRESS"), ("busy", "IN_PROGRESS"), ("never", "IN_PROGRESS"), ("done", "COMPLETED")],
                                 "job_id string, status string")
    pages = spark.createDataFrame([("old", at(0)), ("busy", at(0)), ("busy", at(71)), ("done", at(0))], "job_id string, crawled_at timestamp")
    out = {r.job_id: r.verdict for r in J.idle_jobs(jobs, pages, F.lit(at(100))).collect()}
    assert out == {"old": "completed", "never": "stalled"}


def test_lists_and_pages(spark):
    jobs = spark.createDataFrame([(f"j{i:02}", "u" if i % 2 else "v", "PENDING", at(i * 3600)) for i in range(30)],
                                 "job_id string, user_id string, status string, created_at timestamp")
    out = J.list_jobs(jobs, F.lit(at(29 * 3600 + 59)), status="PENDING", user_id="u", skip=2, limit=3).collect()
    assert [(r.job_id, r.total, r.age) for r in out] == [("j25", 15, "4h ago"), ("j23", 15, "6h ago"), ("j21", 15, "8h ago")]
    assert J.list_jobs(jobs, F.lit(at(29 * 3600 + 59)), limit=1).first().age == "59s ago"
    assert J.list_jobs(jobs, F.lit(at(32 * 86400)), skip=29, limit=1).first().age == "32d ago"
    with pytest.raises(ValueError):
        J.list_jobs(jobs, F.lit(T0), limit=1001)
    broken = spark.createDataFrame([("j", "s", f"b{i}", None, 404, "HTTP_ERROR", "HTTP 404", 1, at(i)) for i in range(5)], BROKEN_LINKS)
    page = J.broken_links_page(broken, "j", 1, 2).collect()
    assert [(r.broken_url, r.total) for r in page] == [("b3", 5), ("b2", 5)]
    assert J.broken_links_page(broken, "other").count() == 0


def test_counters_and_summary(spark):
    pages = spark.createDataFrame([("a", 3, None), ("a", 4, None), ("a", 9, "boom")], "job_id string, links_count int, error string")
    broken = spark.createDataFrame([("a", "s", "x", None, 404, "HTTP_ERROR", "", 1, T0), ("z", "s", "x", None, 404, "HTTP_ERROR", "", 1, T0)], BROKEN_LINKS)
    counters = {r.job_id: r[1:] for r in J.job_counters(pages, broken).collect()}
    assert counters == {"a": (2, 7, 1), "z": (0, 0, 1)}
    jobs = spark.createDataFrame(
        [("a", "http://a", "IN_PROGRESS", 3, 4, T0, at(1), None, None), ("e", "http://e", "FAILED", 3, 4, T0, at(0), at(59), "no"),
         ("n", "http://n", "PENDING", 3, 4, T0, None, None, None)],
        "job_id string, url string, status string, max_depth int, max_pages int, created_at timestamp, started_at timestamp, "
        "completed_at timestamp, error_message string")
    out = {r.job_id: r for r in J.job_summary(jobs, pages, broken, F.lit(at(126))).collect()}
    assert out["a"].statistics.asDict() == {"pages_crawled": 2, "links_found": 7, "broken_links": 1, "max_depth": 3, "max_pages": 4}
    assert (out["a"].elapsed, out["a"].progress, out["e"].elapsed, out["e"].error, out["n"].elapsed) == ("2m 5s", 50.0, "59s", "no", None)


def test_visited_and_delete(spark):
    from linkspark.functions import urls as U
    pages = spark.createDataFrame([("a", "http://x/1"), ("b", "http://x/2")], "job_id string, url string").withColumn(
        "url_hash", F.expr(U.canonical_hash("url")))
    urls = spark.createDataFrame([("a", "http://X/1#f"), ("a", "http://x/2"), ("b", "nope")], "job_id string, url string")
    assert {(r.job_id, r.url): r.visited for r in J.is_visited(urls, pages).collect()} == {
        ("a", "http://X/1#f"): True, ("a", "http://x/2"): False, ("b", "nope"): False}
    tables = {"crawl_jobs": pages.select("job_id"), "crawled_pages": pages, "broken_links": pages.select("job_id"),
              "dead_letters": spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "job_id string, n int")}
    kept = J.delete_jobs(tables, spark.createDataFrame([("a",), ("a",)], "job_id string"))
    assert [r.job_id for r in kept["crawl_jobs"].collect()] == ["b"]
    assert [r.job_id for r in kept["crawled_pages"].collect()] == ["b"] == [r.job_id for r in kept["broken_links"].collect()]
    assert {(r.job_id, r.n) for r in kept["dead_letters"].collect()} == {(None, 1), ("b", 2), (None, 3)}


def test_link_totals(spark):
    rows = [("a", "internal", "h1"), ("a", "external", "h2"), ("a", "external", "h2"), ("a", "external", "h3"), ("b", "internal", "h1")]
    out = {r.job_id: tuple(r)[1:] for r in J.link_totals(spark.createDataFrame(rows, "job_id string, category string, url_hash string")).collect()}
    assert out == {"a": (4, 3, 2), "b": (1, 0, 0)}
