"""Sharding by jump consistent hashing: a stable key and the number of shards decide, no ring table.

Going from n to n + 1 shards, a row stays where it is or moves into the new shard; one row in n + 1 moves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.llm.rows import riding, unpacked
from linkspark.operators.skew import Agg, running

SHARDS = 40
_STEP = np.uint64(2862933555777941757)  # fixed value: the generator of the published algorithm


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key; a key jumps ever further until it leaves the range."""
    state = keys.astype(np.uint64)
    at = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state)) if shards > 1 else np.arange(0)
    while len(live):
        state[live] = state[live] * _STEP + np.uint64(1)
        stride = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead = ((at[live] + 1) * stride).astype(np.int64)
        inside = ahead < shards
        live = live[inside]
        at[live] = ahead[inside]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a bigint key column; a null key counts as 0."""
    if shards < 1:
        raise ValueError("there must be one shard at least")

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards))

    return place(F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint")))


def shard_rows(df: DataFrame, key: str, shards: int = SHARDS, order: tuple[str, ...] = ()) -> DataFrame:
    """``df`` plus ``shard``, ``grown_shard`` (with one more) and ``slot``, gapless from 0 in each shard.

    Slots follow (key, ``order``); rows that tie in both get slots in any order. A null key goes where
    key 0 goes. A non-integer key has to be hashed to a bigint by the caller. Columns of these names
    are replaced. The numbering never holds a shard in one task, see ``running``.
    """
    names, rest = riding(df, replaced=("shard", "grown_shard", "slot"))
    by = [F.col(f"_row.`{c}`").alias(f"_o{i}") for i, c in enumerate((key, *order))]
    placed = df.select(rest, F.monotonically_increasing_id().alias("_tie")).select(
        "_row", "_tie", *by, shard_of(F.col(f"_row.`{key}`"), shards).alias("shard"),
        shard_of(F.col(f"_row.`{key}`"), shards + 1).alias("grown_shard"))
    numbered = running(placed, ["shard"], [*(f"_o{i}" for i in range(len(by))), "_tie"], [Agg("slot", "count", exclusive=True)])
    return numbered.select(*unpacked(names), "shard", "grown_shard", "slot")
