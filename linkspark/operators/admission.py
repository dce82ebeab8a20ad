"""Admission of requests per domain by a token bucket, in closed form over a request log.

A bucket of ``burst`` tokens refilled at ``rate`` per second serves requests in arrival order.
Times are whole numbers (microseconds times the numerator of the rate) in ``decimal(38,0)``, counted
from the first request of all, so the answer is exact, cannot overflow at any length of log and does
not depend on how the rows were partitioned.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.operators.skew import Agg, Step, running, scan
from linkspark.session import lookup_table

RATE, BURST = 1.0, 5
UNITS = "decimal(38,0)"


def _scale(rate: float) -> tuple[int, int]:
    """(p, s): times are micros * p, and one token takes s of those units."""
    per_second = Fraction(rate).limit_denominator(1_000_000)
    return per_second.numerator, 1_000_000 * per_second.denominator


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _times(count: Column, unit: Column) -> Column:
    return (count.cast("decimal(19,0)") * unit.cast("decimal(18,0)")).cast(UNITS)


def _timed(requests: DataFrame, rate: float, domain: str, ts: str, delays: DataFrame | None) -> tuple[DataFrame, int, int]:
    """Requests with arrival ``_t`` and token time ``_s``; the scale and the zero of the times."""
    p, s = _scale(rate)
    first = requests.agg(F.min(micros(ts))).first()[0] or 0
    rows = requests.withColumn("_t", _times(micros(ts) - first, F.lit(p))).withColumn("_s", F.lit(s).cast("decimal(18,0)"))
    if delays is not None:
        own = lookup_table(delays.select(F.col("domain").alias(domain), F.col("crawl_delay").alias("_delay")))
        per_token = (F.round(F.col("_delay") * 1_000_000).cast("decimal(12,0)") * F.lit(p)).cast("decimal(18,0)")
        rows = rows.join(own, domain, "left").withColumn("_s", F.coalesce(per_token, "_s")).drop("_delay")
    return rows, p, first


def _slack(place: str) -> Column:
    return (F.col("_t") - _times(F.col(place) - 1, F.col("_s"))).cast(UNITS)


def _peak() -> Step:
    """``max(t_j - (n_j - 1) s)``: a range counts from 1, and c requests before it make its part smaller by c s."""
    later = _times(F.coalesce("_c__n", F.lit(0)), F.col("_s"))
    return Step("_peak", lambda w: F.max(_slack("_l__n")).over(w), F.max("_l__peak"),
                lambda w: F.max((F.col("_t__peak") - later).cast(UNITS)).over(w),
                F.greatest((F.col("_l__peak") - later).cast(UNITS), F.col("_c__peak")))


def admit(requests: DataFrame, rate: float = RATE, burst: int = BURST, *, domain: str = "domain", ts: str = "ts",
          tie: str = "request_id", delays: DataFrame | None = None) -> DataFrame:
    """Add ``wait_seconds`` and ``start_at``.

    The n-th request of a domain starts at the later of its arrival and
    ``max(t_j - (j-1)/r, j<=n) + (n-burst)/r``: two running aggregates in one scan, no row-by-row state.
    ``delays(domain, crawl_delay)`` overrides the seconds per token of single domains.
    """
    timed, p, first = _timed(requests, rate, domain, ts, delays)
    order = ["_t", tie]
    rows = scan(timed, [domain], order, [Agg("_n", "count").step(order), _peak()], {"_s": F.first("_s")})
    start = F.greatest(F.col("_t"), (F.col("_peak") + _times(F.col("_n") - burst, F.col("_s"))).cast(UNITS))
    return rows.withColumn("_start", start).select(
        *requests.columns,
        ((F.col("_start") - F.col("_t")).cast("double") / float(p * 1_000_000)).alias("wait_seconds"),
        F.timestamp_micros(F.lit(first) + F.expr(f"_start div {p}")).alias("start_at"))


def bucket_status(requests: DataFrame, at: Column, rate: float = RATE, burst: int = BURST, *,
                  domain: str = "domain", ts: str = "ts", tie: str = "request_id") -> DataFrame:
    """Bucket of each domain at a moment, after all requests up to then.

    ``tokens`` is what is left (negative while requests wait for tokens still to come),
    ``full_at`` the moment the bucket is full again if nothing else arrives.
    """
    upto = requests.filter(F.col(ts) <= at)
    timed, p, first = _timed(upto, rate, domain, ts, None)
    rows = running(timed, [domain], ["_t", tie], [Agg("_n", "count")])
    now = _times(F.unix_micros(at.cast("timestamp")) - first, F.lit(p))
    # the moment the bucket is full again after n requests: max(t_j - (j-1)s) + n*s
    state = rows.groupBy(domain).agg(
        F.count("*").alias("requests"), F.max(ts).alias("last_request"), F.max("_s").alias("_s"),
        F.max(_slack("_n")).alias("_peak"))
    state = state.withColumn("_full", (F.col("_peak") + _times(F.col("requests"), F.col("_s"))).cast(UNITS))
    used = F.greatest((F.col("_full") - now).cast("double"), F.lit(0.0)) / F.col("_s").cast("double")
    return state.select(
        domain, "requests", "last_request", (F.lit(float(burst)) - used).alias("tokens"),
        F.timestamp_micros(F.lit(first) + F.expr(f"_full div {p}")).alias("full_at"),
        F.lit(burst).alias("capacity"), F.lit(float(rate)).alias("rate"))
