"""Running aggregates: one hot key, ties, many chunks; the answer never depends on the layout."""
import random
from contextlib import contextmanager

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from linkspark.operators import skew
from linkspark.operators.skew import Agg, running


@contextmanager
def _partitions(spark, n):
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def _rows(seed, n=3000):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.5 else f"k{rnd.randrange(40)}"
        order = 777 if rnd.random() < 0.3 else rnd.randrange(2000)  # one moment holds a third of the rows
        rows.append((key, order, i, rnd.randrange(100), rnd.choice([None, "a", "b"])))
    return rows


def _expected(rows):
    df = pd.DataFrame(rows, columns=["key", "o", "i", "v", "s"]).sort_values(["key", "o", "i"])
    g = df.groupby("key")
    df["n"] = g.cumcount() + 1
    df["total"] = g["v"].cumsum()
    df["top"] = g["v"].cummax()
    df["before"] = g["s"].transform(lambda s: s.ffill().shift())
    return {r.i: (r.n, r.total, r.top, None if pd.isna(r.before) else r.before) for r in df.itertuples()}


@pytest.mark.parametrize("seed", [10, 100])
def test_running_matches_pandas(spark, seed):
    rows = _rows(seed)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "key string, o long, i long, v int, s string").repartition(7)
    out = running(df, ["key"], ["o", "i"], [
        Agg("n", "count"), Agg("total", "sum", F.col("v")), Agg("top", "max", F.col("v")),
        Agg("before", "last", F.col("s"), exclusive=True)])
    want = _expected(rows)
    got = {r.i: (r.n, r.total, r.top, r.before) for r in out.collect()}
    assert got == want


def test_one_key_over_all_ranges(spark):
    """One key holds every row: each range scans a part of it, and only totals are carried."""
    df = spark.range(0, 4000, 1, 7).selectExpr("'hot' as key", "(id * 7919) % 4000 as o", "9000000000000000000bd as v")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = running(df, ["key"], ["o"], [Agg("n", "count"), Agg("total", "sum", F.col("v"))])
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert "_part" in plan and sorted((r.o, r.n) for r in got) == [(i, i + 1) for i in range(4000)]
    assert max(r.total for r in got) == 4000 * 9 * 10**18  # past 2^63


def test_null_keys_form_one_group(spark):
    df = spark.createDataFrame([(None, 1), ("a", 1), (None, 2)], "key string, o int")
    got = {(r.key, r.o): r.n for r in running(df, ["key"], ["o"], [Agg("n", "count")]).collect()}
    assert got == {(None, 1): 1, (None, 2): 2, ("a", 1): 1}


def test_without_keys(spark):
    df = spark.range(1000).selectExpr("id", "1 as one")
    out = running(df, [], ["id"], [Agg("n", "sum", F.col("one"))])
    assert all(r.n == r.id + 1 for r in out.collect())


@pytest.fixture
def tiny_skew(spark):
    """Thresholds so low that the hot key of a test table counts as skewed."""
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _split(df):
    df.collect()
    return "skew" in df._jdf.queryExecution().executedPlan().toString().lower()


def test_lookups_of_a_hot_key_are_split(spark, tiny_skew):
    from linkspark.operators import check, jobs, robots
    n = 20_000
    target = F.when(F.col("id") % 10 != 0, "http://hot.com/x").otherwise(F.concat(F.lit("http://h"), F.col("id"), F.lit(".com/x")))
    edges = spark.range(0, n, 1, 8).select(F.col("id").cast("string").alias("source_url"), target.alias("canonical"),
                                          F.lit("external").alias("category")).withColumn("url_hash", F.sha2("canonical", 256))
    responses = edges.select(F.col("canonical").alias("url"), F.lit(404).alias("head_status"),
                             F.lit(None).cast("int").alias("get_status"), F.lit(None).cast("string").alias("net_error"))
    checked = check.check_links(edges, responses)
    assert _split(checked) and checked.filter("not is_valid").count() == n
    urls = edges.select(F.col("canonical").alias("url"))
    groups = robots.robots_groups(spark.createDataFrame([("hot.com", "User-agent: *\nDisallow: /x")], "host string, body string"))
    judged = robots.robots_allowed(urls, groups)
    assert _split(judged) and judged.filter("not allowed").count() == n * 9 // 10
    seen = jobs.is_visited(urls.withColumn("job_id", F.lit("j")), edges.withColumn("job_id", F.lit("j")).filter("canonical = 'http://hot.com/x'"))
    assert _split(seen) and seen.filter("visited").count() == n * 9 // 10


def test_ranges_are_even_and_in_order(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(
        F.concat(F.lit("k"), F.col("id") % 40)).alias("k"), (F.col("id") * 7919 % 6007).alias("t"))
    for n in (1, 2, 5, 16):
        with _partitions(spark, n):
            dealt = skew._dealt(rows, ["k"], ["t"]).withColumn("p", F.spark_partition_id())
            found = dealt.groupBy("_part").agg(F.count("*").alias("n"), F.min(F.struct("k", "t")).alias("a"),
                                               F.max(F.struct("k", "t")).alias("b"), F.countDistinct("p").alias("p"))
            parts = found.orderBy("_part").collect()
            assert len(parts) == n and sum(r.n for r in parts) == 6000
            assert max(r.n for r in parts) < 2 * 6000 / n + 50 and {r.p for r in parts} == {1}
            ends = [((r.a.k or "", r.a.t), (r.b.k or "", r.b.t)) for r in parts]
            assert all(x[1] < y[0] for x, y in zip(ends, ends[1:]))


def test_steps_share_one_exchange(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"))
    w = Window.partitionBy("_part", "k").orderBy("t")
    local = skew._dealt(rows, ["k"], ["t"]).withColumn("n", F.count("*").over(w)).withColumn("m", F.max("n").over(w))
    plan = local._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange shufflepartitionidpassthrough") == 1 and "hashpartitioning" not in plan


@pytest.mark.parametrize("n", [1, 7])
def test_stretches_over_many_ranges(spark, n):
    from linkspark.streaming.streams import job_sessions
    rnd = random.Random(n)
    rows = [(rnd.choice(["hot", "hot", "hot", "b", "c", None]), rnd.randrange(0, 4000)) for _ in range(700)] + [("one", 5)]
    df = spark.createDataFrame(rows, "job_id string, s long").select("job_id", F.timestamp_seconds("s").alias("crawled_at"))
    want = []
    for job in {j for j, _ in rows}:
        last = None
        for s in sorted(s for j, s in rows if j == job):
            if last is None or s - last > 30:
                want.append([job, s, s, 0])
            want[-1][2:] = [s, want[-1][3] + 1]
            last = s
    with _partitions(spark, n):
        got = job_sessions(df).select("job_id", F.unix_seconds("started_at"), F.unix_seconds("completed_at") - 30, "pages").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))
