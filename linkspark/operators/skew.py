"""Running aggregates over (key, order) that never need one key in one task.

A plain window partitioned by key puts the whole key into one task. Here the rows are dealt to ranges of
(key, order), so a hot key spreads over as many ranges as it needs: bounds come from a sample, a binary search
over them gives each row the number of its range, and that number is the partition the row is sent to. Each
range is scanned on its own, in that one exchange, whatever the number of columns and whether one builds on
another. Only the first and the last key of a range can have rows elsewhere, so what has to be carried over is
two rows per range at most. What a range hands on need not be a plain sum: a step says what its totals are, how
they add up over the ranges before, and how the sum meets the column worked out within the range.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.session import cut, shuffle_partitions

SAMPLED = 60  # rows per range that the bounds are worked out from


@dataclass(frozen=True)
class Step:
    """A column of a scan. Later steps may build on ``_l_<name>``, ``_t_<name>`` and ``_c_<name>`` of earlier ones."""

    name: str
    local: Callable[..., Column]  # of a window over a range's rows of a key, in order
    total: Column                 # aggregate of a range's rows of a key, from what ``local`` has made
    carry: Callable[..., Column]  # of a window over the key's earlier ranges, from totals
    merge: Column                 # from ``_l_<name>`` and ``_c_<name>``; nothing carried is null


@dataclass(frozen=True)
class Agg:
    """One running aggregate. ``exclusive`` leaves the current row out."""

    name: str
    kind: str  # count | sum | max | last
    expr: Column | None = None
    exclusive: bool = False

    def value(self) -> Column:
        return F.lit(1) if self.kind == "count" and self.expr is None else self.expr

    def local(self, window) -> Column:
        frame = window.rowsBetween(Window.unboundedPreceding, -1 if self.exclusive else 0)
        if self.kind == "last":
            return F.last(self.value(), ignorenulls=True).over(frame)
        fn = {"count": F.count, "sum": F.sum, "max": F.max}[self.kind]
        return fn(self.value()).over(frame)

    def total(self, order: list[str]) -> Column:
        if self.kind == "last":
            present = F.when(self.value().isNotNull(), F.struct(*order))
            return F.max_by(self.value(), present)
        fn = {"count": F.count, "sum": F.sum, "max": F.max}[self.kind]
        return fn(self.value())

    def before(self, window) -> Column:
        total = F.col(f"_t_{self.name}")
        if self.kind == "last":
            return F.last(total, ignorenulls=True).over(window)
        return (F.max if self.kind == "max" else F.sum)(total).over(window)

    def merge(self) -> Column:
        here, before = F.col(f"_l_{self.name}"), F.col(f"_c_{self.name}")
        if self.kind == "count":
            return F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
        if self.kind == "sum":
            return F.when(here.isNull() & before.isNull(), None).otherwise(
                F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0)))
        if self.kind == "max":
            return F.greatest(here, before)
        return F.coalesce(here, before)

    def step(self, order: list[str]) -> Step:
        return Step(self.name, self.local, self.total(order), self.before, self.merge())


def _dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` plus ``_part``, the number of its range of (keys, order), with one partition per range."""
    ranges, point = shuffle_partitions(df), F.struct(*keys, *order)
    if ranges == 1:
        return df.withColumn("_part", F.lit(0)).repartitionById(1, F.col("_part"))
    own = df.select(*keys, *order)
    share = min(1.0, SAMPLED * ranges / max(own.count(), 1))
    sampled = own.sample(share, seed=5) if share < 1 else own
    some = sampled.agg(F.sort_array(F.collect_list(point)).alias("_all"))  # SAMPLED rows per range, about
    every = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get(
        "_all", F.floor(i * F.size("_all") / ranges).cast("int")))
    bounds = some.select(F.filter(every, lambda b: b.isNotNull()).alias("_bounds"), F.lit(0).alias("_one"))
    # one row, a bound per range; the array is looked into where it lies, never copied into a row
    rows = df.withColumn("_one", F.lit(0)).join(F.broadcast(bounds), "_one").withColumn("_part", F.lit(0))
    jump = 1 << (ranges - 2).bit_length()
    while jump:
        ahead = F.col("_part") + jump
        rows = rows.withColumn("_part", F.when(F.get("_bounds", ahead - 1) <= point, ahead).otherwise(F.col("_part")))
        jump //= 2
    return rows.drop("_one", "_bounds").repartitionById(ranges, F.col("_part"))


def scan(df: DataFrame, keys: list[str], order: list[str], steps: list[Step],
         totals: Mapping[str, Column] | None = None) -> DataFrame:
    """``df`` plus one column per step, over ``order`` within ``keys``.

    ``order`` must be unique within a key for a stable answer; without keys the steps run over all rows. Null keys
    form one key. ``totals`` are further aggregates of a range's rows that carries may use. The rows are stored once
    in the scratch folder, with what has been worked out within their ranges.
    """
    inside, rows = Window.partitionBy("_part", *keys).orderBy(*order), _dealt(df, keys, order)
    for step in steps:
        rows = rows.withColumn(f"_l_{step.name}", step.local(inside))
    rows = cut(rows)

    edges, own = rows, F.struct(*keys) if keys else F.lit(0)
    if keys:
        ends = rows.groupBy("_part").agg(F.array(F.min(own), F.max(own)).alias("_ends"))  # a row per range
        ends = ends.select(F.col("_part").alias("_p"), "_ends")
        edges = rows.join(F.broadcast(ends), F.col("_part") == F.col("_p")).filter(
            (own == F.get("_ends", F.lit(0))) | (own == F.get("_ends", F.lit(1)))).drop("_p", "_ends")
    summed = edges.groupBy("_part", *keys).agg(*[s.total.alias(f"_t_{s.name}") for s in steps],
                                               *[c.alias(n) for n, c in (totals or {}).items()])
    across = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part")  # two rows per range at most
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    for step in steps:
        summed = summed.withColumn(f"_c_{step.name}", step.carry(before))
    carried = summed.withColumn("_rank", F.row_number().over(across)).filter("_rank > 1").select(
        F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        *[f"_c_{s.name}" for s in steps])

    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)],
                  F.col("_part") == F.col("_p"))
    # two rows per range: the bound of what is broadcast is the number of shuffle partitions
    merged = rows.join(F.broadcast(carried), same, "left")
    return merged.select(*df.columns, *[s.merge.alias(s.name) for s in steps])


def running(df: DataFrame, keys: list[str], order: list[str], aggs: list[Agg]) -> DataFrame:
    """``df`` plus one column per plain running aggregate; see :func:`scan`."""
    return scan(df, keys, order, [a.step(order) for a in aggs])
