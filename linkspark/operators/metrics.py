"""Crawl metrics as windowed aggregates over event tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.operators.skew import Agg, running
from linkspark.session import lookup_table

# Bucket bounds (seconds) of the page-crawl histogram, and the customary default ones.
CRAWL_BOUNDS = (0.5, 1.0, 2.0, 5.0, 10.0, 30.0)
DEFAULT_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def seconds(interval: str) -> int:
    count, unit = interval.split()
    return int(count) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def rate(events: DataFrame, window: str = "1 minute", slide: str | None = None,
         by: Sequence[str] = (), ts: str = "ts", quiet: bool = False) -> DataFrame:
    """Events per second in sliding windows, also per value of ``by``.

    ``quiet`` adds the windows without events between the first and the last one of each group, at rate 0.
    """
    if quiet:
        return _quiet(rate(events, window, slide, by, ts), seconds(slide or window), list(by))
    wide, step = seconds(window), seconds(slide or window)
    if events.isStreaming or wide % step:
        counted = events.groupBy(F.window(ts, window, slide or window).alias("_w"), *by).agg(F.count("*").alias("events"))
        counted = counted.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *by, "events")
    else:  # count each slide once, then add neighbours: the events are not multiplied
        slides = events.groupBy(F.window(ts, slide or window)["start"].alias("_s"), *by).agg(F.count("*").alias("_n"))
        back = F.transform(F.sequence(F.lit(0), F.lit(wide // step - 1)), lambda i: F.make_interval(secs=i * step))
        starts = slides.select(F.col("_s"), "_n", *by, F.explode(back).alias("_back"))
        start = F.col("_s") - F.col("_back")
        counted = starts.groupBy(start.alias("window_start"), *by).agg(F.sum("_n").alias("events")).select(
            "window_start", (F.col("window_start") + F.make_interval(secs=F.lit(wide))).alias("window_end"), *by, "events")
    return counted.select("window_start", "window_end", *by, "events", (F.col("events") / wide).alias("per_second"))


def _quiet(rates: DataFrame, slide: int, by: list[str]) -> DataFrame:
    span = rates.groupBy(*by).agg(F.min("window_start").alias("_a"), F.max("window_start").alias("_b"),
                                  F.first(F.col("window_end") - F.col("window_start")).alias("_w"))
    starts = span.filter("_a is not null").select(
        *by, F.explode(F.sequence("_a", "_b", F.make_interval(secs=F.lit(slide)))).alias("window_start"), "_w")
    rows = starts.join(rates.drop("window_end"), ["window_start", *by], "left")
    return rows.select("window_start", (F.col("window_start") + F.col("_w")).alias("window_end"), *by,
                       F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("per_second", F.lit(0.0)).alias("per_second"))


def percentiles(events: DataFrame, col: str, shares: Sequence[float], by: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """Exact percentiles (linear between two ranks), a row per group and share: ``share, exact``.

    Ranks are selected without holding a group anywhere. A mergeable sketch, whose ranks are off by ``1 / accuracy``
    of a group's rows at most, gives two values that surely enclose the asked ranks. Rows below are counted, rows
    between are counted by value, and running sums over these values, split over tasks, find the ranks.
    Null values don't count; groups without any other have no row.
    """
    keys, asked, off = list(by), [float(q) for q in shares], 2.0 / accuracy
    own = events.filter(F.col(col).isNotNull()).select(*keys, F.col(col).cast("double").alias("_v"))
    near = F.percentile_approx("_v", F.array(*[F.lit(min(1.0, max(0.0, q + d))) for d in (-off, off) for q in asked]), F.lit(accuracy))
    m = len(asked)
    ends = F.concat(F.array_repeat(F.min("_v"), m), F.array_repeat(F.max("_v"), m))
    # a sketch is near enough by half of what is allowed, and two ranks more; those of small groups are enclosed by all rows
    groups = own.groupBy(*keys).agg(F.count("*").alias("_n"), near.alias("_near"), ends.alias("_ends"))
    groups = groups.withColumn("_near", F.when(F.col("_n") < 2 * accuracy, F.col("_ends")).otherwise(F.col("_near")))
    groups = lookup_table(groups.filter("_n > 0").select(
        *[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], "_n",
        F.slice("_near", 1, m).alias("_low"), F.slice("_near", m + 1, m).alias("_high")))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)], F.lit(True))
    rows = own.join(groups, same) if keys else own.join(F.broadcast(groups.withColumn("_g", F.lit(0))), F.lit(0) == F.col("_g"))
    rows = rows.select(*keys, "_v", "_low", "_high", "_n")

    below = rows.groupBy(*keys, "_n").agg(F.array(*[F.count_if(F.col("_v") < F.col("_low")[j]) for j in range(m)]).alias("_below"))
    below = below.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], "_n", F.posexplode("_below").alias("_j", "_base"))
    inside = F.filter(F.sequence(F.lit(0), F.lit(m - 1)), lambda j: F.col("_v").between(F.get("_low", j), F.get("_high", j)))
    values = rows.select(*keys, "_v", F.explode(inside).alias("_j")).groupBy(*keys, "_j", "_v").agg(F.count("*").alias("_c"))
    summed = running(values, [*keys, "_j"], ["_v"], [Agg("_upto", "sum", F.col("_c"))])

    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)], F.col("_j") == F.col("_k"))
    found = summed.join(lookup_table(below.withColumnRenamed("_j", "_k")), same)
    place = F.get(F.array(*map(F.lit, asked)), F.col("_j")) * (F.col("_n") - 1)
    end = F.col("_base") + F.col("_upto")

    def ranked(rank: Column) -> Column:
        return F.max(F.when((end > rank) & (end - F.col("_c") <= rank), F.col("_v")))
    picked = found.groupBy(*keys, "_j").agg(ranked(F.floor(place)).alias("_a"), ranked(F.ceil(place)).alias("_b"), F.max(place).alias("_p"))
    share = F.col("_p") - F.floor("_p")
    return picked.select(*keys, F.get(F.array(*map(F.lit, asked)), F.col("_j")).alias("share"),
                         F.when(share == 0, F.col("_a")).otherwise((1 - share) * F.col("_a") + share * F.col("_b")).alias("exact"))


def sketches(events: DataFrame, col: str, window: str = "1 minute", by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """(window_start, by, rows, sketch): a mergeable quantile sketch of ``col`` per window. Rows without a value don't count."""
    own = events.filter(F.col(col).isNotNull())
    return own.groupBy(F.window(ts, window)["start"].alias("window_start"), *by).agg(
        F.count("*").alias("rows"), F.kll_sketch_agg_double(F.col(col).cast("double")).alias("sketch"))


def rolled_up(parts: DataFrame, window: str = "1 day", by: Sequence[str] = ()) -> DataFrame:
    """Sketches of wider windows from those of narrower ones; the events aren't read again."""
    return parts.groupBy(F.window("window_start", window)["start"].alias("window_start"), *by).agg(
        F.sum("rows").alias("rows"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_percentiles(parts: DataFrame, shares: Sequence[float]) -> DataFrame:
    """A row per sketch and share: ``share, approximate``."""
    read = F.array(*[F.struct(F.lit(float(q)).alias("share"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias("approximate"))
                     for q in shares])
    return parts.select(*[c for c in parts.columns if c != "sketch"], F.inline(read))


def failure_rate(events: DataFrame, window: str = "5 minutes", slide: str | None = None,
                 status: str = "status", ts: str = "ts") -> DataFrame:
    """Failures per second, and their share of all task events, per window."""
    failed = F.coalesce(F.col(status) == "FAILURE", F.lit(False))
    # counted by slides, as any rate is: the events aren't multiplied by the windows they lie in
    rates = rate(events.withColumn("_failed", failed), window, slide, ["_failed"], ts)
    mine = F.when(F.col("_failed"), F.col("events")).otherwise(F.lit(0))
    counted = rates.groupBy("window_start").agg(F.sum(mine).alias("failures"), F.sum("events").alias("events"))
    return counted.select("window_start", "failures", "events", (F.col("failures") / seconds(window)).alias("per_second"),
                          (F.col("failures") / F.col("events")).alias("share"))


def histogram(events: DataFrame, col: str, bounds: Sequence[float] = CRAWL_BOUNDS,
              by: Sequence[str | Column] = ()) -> DataFrame:
    """Cumulative counts ``le, cumulative`` per group; the last bound is +Infinity.

    All bounds are counted in one aggregation and unrolled afterwards, so the input rows are
    never multiplied by the number of bounds.
    """
    edges = [*map(float, bounds), float("inf")]
    counts = F.array(*[F.count_if(F.col(col) <= b) for b in edges]).alias("_counts")
    grouped = events.groupBy(*by).agg(counts)
    names = [c for c in grouped.columns if c != "_counts"]
    pairs = F.arrays_zip(F.array(*[F.lit(b) for b in edges]).alias("le"), F.col("_counts").alias("cumulative"))
    return grouped.select(*names, F.inline(pairs))


def histogram_quantile(hist: DataFrame, q: float, by: Sequence[str] = ()) -> DataFrame:
    """Quantile read off a cumulative histogram, linear inside the bucket.

    A quantile in the +Infinity bucket gives the largest finite bound; an empty histogram NULL.
    """
    rows = hist.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("le", "cumulative"))).alias("_h"))
    total = F.element_at("_h", -1)["cumulative"]
    target = total * F.lit(float(q))

    def read(h: Column) -> Column:
        at = F.size(F.filter(h, lambda b: b["cumulative"] < target))  # buckets before the quantile
        here, before = F.get(h, at), F.get(h, at - 1)
        low = F.when(at == 0, 0.0).otherwise(before["le"])
        below = F.when(at == 0, 0).otherwise(before["cumulative"])
        share = (target - below) / (here["cumulative"] - below)
        return (F.when(total == 0, None)
                .when(here["le"] == float("inf"), F.get(h, F.size(h) - 2)["le"])
                .when(here["cumulative"] == below, low)
                .otherwise(low + (here["le"] - low) * share))

    return rows.select(*by, total.alias("observations"), read(F.col("_h")).alias("quantile"))


def _steps(changes: Sequence[DataFrame], keys: list[str], value: str) -> DataFrame:
    """Running sum of +1/-1 changes, one row per moment; many changes at once are summed first."""
    moments = reduce(DataFrame.unionByName, changes).groupBy(*keys, "ts").agg(F.sum("delta").alias("delta"))
    moments = moments.withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp")))
    return running(moments, keys, ["_t"], [Agg(value, "sum", F.col("delta"))]).select(
        *keys, "ts", value)


def active_jobs(jobs: DataFrame) -> DataFrame:
    """Number of running jobs after every start and end (``started_at``, ``completed_at``)."""
    started = jobs.filter("started_at is not null")
    up = started.select(F.col("started_at").alias("ts"), F.lit(1).cast("long").alias("delta"))
    down = started.filter("completed_at >= started_at").select(
        F.col("completed_at").alias("ts"), F.lit(-1).cast("long").alias("delta"))
    return _steps([up, down], [], "active")


def active_jobs_at(jobs: DataFrame, at: Column) -> DataFrame:
    return jobs.agg(F.count_if((F.col("started_at") <= at) & (
        F.col("completed_at").isNull() | (F.col("completed_at") > at))).alias("active"))


def backlog(events: DataFrame, enqueued: str = "enqueued", finished: str = "finished",
            queue: str = "queue") -> DataFrame:
    """Queue depth over time from ``(queue, ts, kind)``."""
    delta = F.when(F.col("kind") == enqueued, 1).when(F.col("kind") == finished, -1)
    changes = events.select(queue, "ts", delta.cast("long").alias("delta")).filter("delta is not null")
    return _steps([changes], [queue], "depth")


def totals(events: DataFrame, by: Sequence[str]) -> DataFrame:
    return events.groupBy(*by).agg(F.count("*").alias("total"))
