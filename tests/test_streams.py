"""Streams over files: same answers as batch, late rows, restarts, redelivery."""
import random
import time
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from linkspark.operators import admission as A
from linkspark.sources import sinks
from linkspark.sources.tables import parse_link_jobs, read_pages
from linkspark.streaming import closing, counters
from linkspark.streaming import streams as X

T0 = datetime(2024, 1, 1)


def at(s):
    return T0 + timedelta(seconds=s)


class Feed:
    """A folder of files read as a stream, one file per trigger."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, path, schema
        self.files = 0

    def add(self, rows):
        self.files += 1
        df = self.spark.createDataFrame(rows, self.schema).coalesce(1)
        df.write.mode("append").parquet(str(self.path))

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.path))


def run(df, tmp_path, mode="append", name="out"):
    out = str(tmp_path / name)
    if mode == "append":
        query = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "_cp")
                 .outputMode(mode).trigger(availableNow=True).start())
        query.awaitTermination(120)
        return df.sparkSession.read.parquet(out).collect()
    rows = {}

    def keep(batch, _):
        for r in batch.collect():
            rows[r.job_id] = r
    query = (df.writeStream.foreachBatch(keep).option("checkpointLocation", out + "_cp").outputMode(mode)
             .trigger(availableNow=True).start())
    query.awaitTermination(120)
    return list(rows.values())


def test_dedupe_with_restart(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "job_id string, url string, ts timestamp")
    feed.add([("a", "http://x/1", at(0)), ("a", "http://X/1#f", at(1)), ("b", "http://x/1", at(2)), ("a", "nope", at(2))])
    first = run(X.dedupe_stream(feed.stream()), tmp_path)
    assert {(r.job_id, r.ts) for r in first} == {("a", at(0)), ("b", at(2))}
    feed.add([("a", "http://x/1/", at(60)), ("a", "http://x/2", at(61))])
    again = run(X.dedupe_stream(feed.stream()), tmp_path)
    assert {(r.job_id, r.url) for r in again} == {("a", "http://x/1"), ("b", "http://x/1"), ("a", "http://x/2")}


def test_completion(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "job_id string, crawled_at timestamp")
    feed.add([("a", at(0)), ("a", at(20)), ("b", at(5)), ("a", at(45))])
    feed.add([("c", at(400))])
    feed.add([("c", at(800))])
    rows = run(X.completions_stream(feed.stream()), tmp_path)
    assert {(r.job_id, r.completed_at, r.pages) for r in rows} >= {("a", at(75), 3), ("b", at(35), 1)}
    batch = X.job_sessions(spark.read.parquet(str(tmp_path / "in")))
    assert {tuple(r) for r in rows} <= {tuple(r) for r in batch.collect()}


def test_rates_drop_late_rows(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "ts timestamp, kind string")
    feed.add([(at(0), "a"), (at(30), "a"), (at(59), "b")])
    feed.add([(at(600), "a")])
    feed.add([(at(610), "a")])  # late rows are measured against the watermark of the batch before
    feed.add([(at(10), "late")])
    feed.add([(at(1200), "a")])
    rows = run(X.rate_stream(feed.stream(), "1 minute", "1 minute"), tmp_path)
    assert (at(0), 3) in {(r.window_start, r.events) for r in rows}
    assert sum(r.events for r in rows if r.window_start == at(0)) == 3


def test_live_counters(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "job_id string, links_count int")
    feed.add([("a", 2), ("b", 1)])
    feed.add([("a", 5)])
    rows = {r.job_id: (r.total_pages_crawled, r.total_links_found) for r in run(X.counters_stream(feed.stream()), tmp_path, "update")}
    assert rows == {"a": (2, 7), "b": (1, 1)}


def test_link_check_stream(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "key string, value string")
    message = '{"job_id":"j","source_url":"http://s/","target_urls":["http://b/1","http://b/2"],"depth":1}'
    feed.add([("j", message), ("j", "{broken")])
    responses = spark.createDataFrame([("http://b/1", 404, None, None), ("http://b/2", 200, None, None), ("http://b/3", None, None, "timeout")],
                                      "url string, head_status int, get_status int, net_error string")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    X.check_stream(feed.stream(), responses, out, checkpoint).awaitTermination(120)
    feed.add([("j", message), ("j", message.replace("b/2", "b/3")), ("j", message.replace("http://b/1", "http://[b/").replace("b/2", "unseen"))])
    X.check_stream(feed.stream(), responses, out, checkpoint).awaitTermination(120)
    links = spark.read.parquet(out + "/links").collect()
    assert sorted((r.broken_url, r.error_type) for r in links) == [
        ("http://[b/", "INVALID_URL"), ("http://b/1", "HTTP_ERROR"), ("http://b/3", "TIMEOUT")]
    assert [r.target_url for r in spark.read.parquet(out + "/unseen").collect()] == ["http://unseen"]
    assert spark.read.parquet(out + "/rejected").count() == 1


def test_message_stream(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "key string, value string")
    feed.add([("j", '{"job_id":"j","source_url":"s","target_urls":["u","v"],"depth":1}'), ("j", "[]")])
    good, rejected = parse_link_jobs(feed.stream())
    assert {(r.pos, r.target_url) for r in run(good, tmp_path)} == {(1, "u"), (2, "v")}
    assert len(run(rejected, tmp_path, name="bad")) == 1


def test_batches_are_idempotent(spark, tmp_path):
    rows = [("j", "s", f"b{i}", None, 404, "HTTP_ERROR", "HTTP 404", 1, at(i)) for i in range(3)]
    from linkspark.schemas import BROKEN_LINKS
    found = spark.createDataFrame(rows + rows, BROKEN_LINKS)
    once = sinks.new_broken_links(found)
    path = str(tmp_path / "links")
    for _ in range(2):
        sinks.append_batch(once, path, 0)
    assert spark.read.parquet(path).count() == 3
    more = spark.createDataFrame(rows[:1] + [("j", "s", "new", None, 500, "HTTP_ERROR", "HTTP 500", 1, at(9))], BROKEN_LINKS)
    assert [r.broken_url for r in sinks.new_broken_links(more, spark.read.parquet(path)).collect()] == ["new"]


def test_page_upsert_and_log(spark):
    schema = "job_id string, url_hash string, title string, crawled_at timestamp"
    old = spark.createDataFrame([("j", "h1", "old", at(5)), ("j", "h2", "kept", at(5)), ("k", "h1", "other job", at(5))], schema)
    new = spark.createDataFrame([("j", "h1", "same time", at(5)), ("j", "h2", "too old", at(1)), ("j", "h3", "added", at(1))], schema)
    out = {(r.job_id, r.url_hash): r.title for r in sinks.upsert_pages(new, old).collect()}
    assert out == {("j", "h1"): "same time", ("j", "h2"): "kept", ("k", "h1"): "other job", ("j", "h3"): "added"}


def test_missing_pages_carry_an_error(spark, tmp_path):
    path = str(tmp_path / "pages")
    spark.createDataFrame([("u", "<p>"), ("v", None)], "url string, html string").write.parquet(path)
    assert {r.url: r.error for r in read_pages(spark, path).collect()} == {"u": None, "v": "No response received"}


def _closed(df):
    return sorted(((r.job_id, r.started_at, r.completed_at, r.pages) for r in df.collect()), key=str)


def _append(query, out):
    return (query.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "_cp")
            .trigger(availableNow=True).start())


def test_closing_by_event_time_with_restart(spark, tmp_path):
    feed, out = Feed(spark, tmp_path / "in", "job_id string, crawled_at timestamp"), str(tmp_path / "out")

    def drained():
        with closing.timer_state(spark):
            _append(closing.closing_stream(feed.stream()), out).awaitTermination(180)
        return _closed(spark.read.parquet(out))
    feed.add([("a", at(0)), ("a", at(20)), ("b", at(5)), ("a", at(200)), ("a", None), (None, at(7))])
    first = drained()
    # the watermark is at 170 after the first file: what ended by then is closed, the open stretch of a isn't
    assert set(first) == {("a", at(0), at(50), 2), ("b", at(5), at(35), 1), (None, at(7), at(37), 1)}
    feed.add([("a", at(225)), ("c", at(190))])  # goes on in a stretch that was open before the restart
    feed.add([("c", at(900))])
    rows = drained()
    assert ("a", at(200), at(255), 2) in rows and ("c", at(190), at(220), 1) in rows and len(rows) == len(set(rows))
    want = {tuple(r) for r in X.job_sessions(spark.read.parquet(str(tmp_path / "in"))).select(
        "job_id", "started_at", "completed_at", "pages").collect()}
    assert want - set(rows) == {("c", at(900), at(930), 1)} and set(rows) <= want


def test_a_silent_job_closes_by_the_clock(spark, tmp_path):
    feed, out = Feed(spark, tmp_path / "in", "job_id string, crawled_at timestamp"), str(tmp_path / "out")
    feed.add([("a", at(0)), ("a", at(1)), ("a", at(100))])
    with closing.timer_state(spark):
        df = closing.closing_stream(feed.stream(), "3 seconds", clock="processing")
        query = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "_cp")
                 .trigger(processingTime="1 second").start())
    try:  # no other event ever comes
        for _ in range(120):
            time.sleep(1)
            if query.exception() is not None:
                raise query.exception()
            if (tmp_path / "out" / "_spark_metadata").exists() and _closed(spark.read.schema(df.schema).parquet(out)):
                break
    finally:
        query.stop()
    assert _closed(spark.read.parquet(out)) == [("a", at(0), at(4), 2), ("a", at(100), at(103), 1)]
    with pytest.raises(ValueError):
        closing.closing_stream(feed.stream(), clock="sun")


def test_stretches_merge():
    rnd = random.Random(2)
    for _ in range(50):
        times = [rnd.randrange(0, 300) for _ in range(rnd.randrange(0, 40))]
        want = []
        for t in sorted(times):
            if want and t - want[-1][1] <= 9:
                want[-1] = (want[-1][0], t, want[-1][2] + 1)
            else:
                want.append((t, t, 1))
        cut = rnd.randrange(0, len(times) + 1)
        assert closing.merged([*closing.merged([(t, t, 1) for t in times[:cut]], 9), *((t, t, 1) for t in times[cut:])], 9) == want


def test_a_batch_of_the_check_reads_only_itself(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "key string, value string")
    message = '{"job_id":"j","source_url":"http://s/%d","target_urls":["http://b/1"],"depth":1}'
    responses = spark.createDataFrame([("http://b/1", 404, None, None)], "url string, head_status int, get_status int, net_error string")
    for i in range(4):
        feed.add([("j", message % i), ("j", message % 0), ("j", "{broken")])
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    query = X.check_stream(feed.stream(), responses, out, checkpoint)
    query.awaitTermination(180)
    links = spark.read.parquet(out + "/links")
    assert sorted(r.source_url for r in links.collect()) == [f"http://s/{i}" for i in range(4)]
    assert {(r.batch_id, r.source_url) for r in links.collect()} == {(i, f"http://s/{i}") for i in range(4)}
    assert spark.read.parquet(out + "/rejected").count() == 1
    read = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert len(read) == 4 and len(set(read)) == 1  # the same number for every batch, whatever came before


def test_counters_by_batches(spark, tmp_path):
    path = str(tmp_path / "counters")

    def pages(*rows):
        return spark.createDataFrame(rows, "job_id string, links_count int, error string")

    def read(upto=None):
        return {r.job_id: (r.total_pages_crawled, r.total_links_found) for r in counters.read_counters(spark, path, upto).collect()}
    assert read() == {}
    counters.count_batch(pages(("a", 2, None), ("a", None, None), ("b", 1, None), ("b", 9, "no page"), (None, 4, None)), path, 0)
    counters.count_batch(pages(("a", 5, None)), path, 1)
    whole = {"a": (3, 7), "b": (1, 1), None: (1, 4)}
    assert read() == whole and read(0) == {"a": (2, 2), "b": (1, 1), None: (1, 4)}
    counters.count_batch(pages(("a", 5, None)), path, 1)  # delivered again
    assert read() == whole
    counters.forget_jobs(pages(("a", 0, None), (None, 0, None)).select("job_id"), path, 2)
    assert read() == {"b": (1, 1)}
    counters.count_batch(pages(("a", 1, None)), path, 3)
    assert read() == {"a": (1, 1), "b": (1, 1)}
    for _ in range(2):
        counters.compact(spark, path, 2)
        assert read() == {"a": (1, 1), "b": (1, 1)}
    (tmp_path / "counters" / "base" / "upto=3").mkdir()  # a compaction that never ended
    assert read() == {"a": (1, 1), "b": (1, 1)}


def test_merge_rewrites_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "pages")
    schema = "job_id string, url_hash string, title string, crawled_at timestamp"

    def pages(*rows):
        return spark.createDataFrame([("j", h, t, at(s)) for h, t, s in rows], schema)

    def files():
        return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in sorted((tmp_path / "pages").rglob("*.parquet"))}

    def rows():
        return {(r.url_hash, r.title) for r in spark.read.parquet(path).collect()}
    sinks.merge_pages(pages(("aa1", "old", 5), ("aa2", "kept", 5), ("bb1", "other", 5)), path)
    before = files()
    sinks.merge_pages(pages(("aa1", "new", 6), ("aa2", "too old", 1), ("cc1", "added", 1)), path)
    assert rows() == {("aa1", "new"), ("aa2", "kept"), ("bb1", "other"), ("cc1", "added")}
    after = files()
    assert {f: t for f, t in after.items() if "part=bb" in f} == {f: t for f, t in before.items() if "part=bb" in f}
    assert not any("part=aa" in f and f in before for f in after)
    sinks.merge_pages(pages(("aa1", "new", 6), ("aa2", "too old", 1), ("cc1", "added", 1)), path)
    assert rows() == {("aa1", "new"), ("aa2", "kept"), ("bb1", "other"), ("cc1", "added")}


class Calls:
    """What a job's processor asks of its executor."""

    def __init__(self):
        self.spans, self.timers, self.made, self.watermark = [], set(), 0, 0

    def getListState(self, *_):
        return self

    def get(self):
        self.made += 1
        return iter(self.spans)

    def put(self, spans):
        self.made, self.spans = self.made + 1, list(spans)

    def clear(self):
        self.put([])

    def listTimers(self):
        self.made += 1
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.made += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.made += 1
        self.timers.discard(at)

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_a_job_with_many_stretches_asks_little():
    job, own = Calls(), closing.Closing(10_000, "event")
    own.init(job)
    rnd = random.Random(4)
    times, told = [rnd.randrange(0, 5_000_000) for _ in range(600)], []
    for cut in (0, 200, 400):  # three batches; the watermark stays behind
        batch = pd.DataFrame({"moment": times[cut:cut + 200]})
        own.handleInputRows(("a",), iter([batch[:50], batch[:0], batch[50:]]), job)
    assert job.made <= 3 * 5 and len(job.timers) == 1
    want = closing.merged([(t, t, 1) for t in times], 10_000)
    assert len(want) > 100 and job.spans == want
    for job.watermark in (1000, 3000, 6000):
        while due := [t for t in sorted(job.timers) if t <= job.watermark]:
            for frame in own.handleExpiredTimer(("a",), job, None):
                told += [tuple(r[1:]) for r in frame.itertuples(index=False)]
            job.timers.discard(due[0])
        assert told == [s for s in want if -(-(s[1] + 10_000) // 1000) <= job.watermark]
    assert told == want and not job.spans and not job.timers and job.made <= 3 * 5 + 3 * 3
