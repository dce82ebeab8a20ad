"""Rates, histograms, quantiles, gauges."""
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from linkspark.operators import metrics as M

T0 = datetime(2024, 1, 1)


def at(s):
    return T0 + timedelta(seconds=s)


def test_rates(spark):
    df = spark.createDataFrame([(at(s), k) for s, k in [(0, "a"), (10, "a"), (59, "b"), (60, "a")]], "ts timestamp, kind string")
    one = {r.window_start: (r.events, r.per_second) for r in M.rate(df, "1 minute").collect()}
    assert one == {at(0): (3, 3 / 60), at(60): (1, 1 / 60)}
    sliding = {r.window_start: r.events for r in M.rate(df, "1 minute", "30 seconds").collect()}
    assert sliding == {at(-30): 2, at(0): 3, at(30): 2, at(60): 1}
    by = {(r.window_start, r.kind): r.events for r in M.rate(df, "1 minute", by=["kind"]).collect()}
    assert by == {(at(0), "a"): 2, (at(0), "b"): 1, (at(60), "a"): 1}
    status = df.withColumn("status", F.when(F.col("kind") == "b", "FAILURE").otherwise("SUCCESS"))
    row = M.failure_rate(status, "1 minute").orderBy("window_start").first()
    assert (row.failures, row.events, row.per_second) == (1, 3, 1 / 60)


def test_histogram_and_quantile(spark):
    values = [0.1, 0.5, 0.6, 1.5, 3, 9, 31]
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("big", 99.0), ("big", 77.0)], "k string, v double")
    hist = M.histogram(df, "v", by=["k"])
    got = {(r.k, r.le): r.cumulative for r in hist.collect()}
    assert [got["g", b] for b in (*M.CRAWL_BOUNDS, float("inf"))] == [2, 3, 4, 5, 6, 6, 7]
    q = {r.k: r.quantile for r in M.histogram_quantile(hist, 0.5, ["k"]).collect()}
    assert q["g"] == pytest.approx(1.5) and q["big"] == 30.0
    assert {r.k: r.quantile for r in M.histogram_quantile(hist, 1.0, ["k"]).collect()}["g"] == 30.0
    first = {r.k: r.quantile for r in M.histogram_quantile(hist, 0.1, ["k"]).collect()}["g"]
    assert first == pytest.approx(0.5 * 0.7 / 2)


def test_gauges(spark):
    rnd = random.Random(3)
    jobs = []
    for _ in range(80):
        start = rnd.randrange(100)
        jobs.append((at(start), at(start + rnd.randrange(1, 30)) if rnd.random() < 0.8 else None))
    jobs.append((None, at(5)))
    df = spark.createDataFrame(jobs, "started_at timestamp, completed_at timestamp")
    for r in M.active_jobs(df).collect():
        want = sum(s is not None and s <= r.ts and (e is None or e > r.ts) for s, e in jobs)
        assert r.active == want
        assert M.active_jobs_at(df, F.lit(r.ts)).first().active == want if rnd.random() < 0.03 else True
    events = [(rnd.choice("pq"), at(i // 2), rnd.choice(["enqueued", "finished", "other"])) for i in range(200)]
    depth = M.backlog(spark.createDataFrame(events, "queue string, ts timestamp, kind string"))
    for r in depth.collect():
        seen = [k for q, t, k in events if q == r.queue and t <= r.ts]
        assert r.depth == seen.count("enqueued") - seen.count("finished")


def test_totals(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    assert {r.k: r.total for r in M.totals(df, ["k"]).collect()} == {"a": 2, "b": 1}


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_exact_percentiles_by_ranks(spark, accuracy):
    rnd = random.Random(accuracy)
    rows = [("hot", rnd.choice([rnd.gauss(0, 1), 5.0, -1e200, 1e-300])) for _ in range(4000)] + [("one", 7.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    rows += [(None, float(i)) for i in range(11)] + [("same", 3.0)] * 500
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    shares = (0.0, 0.25, 0.5, 0.95, 0.999, 1.0)
    got = {(r.k, r.share): r.exact for r in M.percentiles(df, "v", shares, ["k"], accuracy).collect()}
    want = {}
    for k in {k for k, v in rows if v is not None}:
        own = sorted(v for x, v in rows if x == k and v is not None)
        for q in shares:
            at = q * (len(own) - 1)
            a, b = own[math.floor(at)], own[math.ceil(at)]
            want[k, q] = a if a == b else (1 - at % 1) * a + at % 1 * b
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    whole = {r.share: r.exact for r in M.percentiles(df, "v", (0.5,), accuracy=accuracy).collect()}
    own = sorted(v for _, v in rows if v is not None)
    assert whole[0.5] == pytest.approx((own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2)
    assert M.percentiles(df.filter("k = 'none'"), "v", (0.5,), ["k"]).count() == 0


def test_no_group_is_held_for_percentiles(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    plan = M.percentiles(df, "v", (0.5,), ["k"])._jdf.queryExecution().toString()
    assert " percentile(" not in plan and "collect_list(_v" not in plan


def test_sketches_roll_up(spark):
    df = spark.range(5000).select(F.timestamp_seconds(F.col("id") * 20).alias("ts"), (F.col("id") % 1000).cast("double").alias("v"))
    parts = M.sketches(df, "v", "1 hour")
    assert parts.count() > 20
    read = M.sketch_percentiles(M.rolled_up(parts, "30 days"), (0.1, 0.5, 0.9)).collect()
    assert [r.rows for r in read] == [5000] * 3
    assert all(abs(r.approximate - 1000 * r.share) < 30 for r in read)
